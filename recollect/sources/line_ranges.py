"""JSON lines read by ranges of bytes, as a table and as a stream.

A file of any size is read by many tasks, each of which takes as many ranges as make up
``TASK`` bytes. A line belongs to the range in which its line
feed lies, so each task looks back for the beginning of its first line and no line is
read twice. A stream's offset is the length of each file as it was listed: a line that
was still being written is told once its line feed is there.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of a range, of what is read at once, and of the first look back for a line's beginning.
RANGE, BLOCK, BACK = 64 << 20, 1 << 20, 4 << 10
#: Bytes of the ranges that one task reads, and what a file counts at least.
TASK, OPEN = 32 << 20, 256 << 10
#: Lines, and bytes of lines, that a batch may hold before it is sent.
_LINES, _SENT = 4096, 8 << 20
SCHEMA = "path string, pos long, line binary, ended boolean"


@dataclass
class ByteRanges(InputPartition):
    """Ranges of ``size`` bytes in the parts of files: (path, start, stop, whether a last line without a line feed is told as well)."""

    parts: list[tuple[str, int, int, bool]]
    size: int


def _located(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def _sizes(uri: str, glob: str) -> dict[str, int]:
    """The files below ``uri``, by their URIs, with their lengths."""
    system, root = _located(uri)
    head = uri.split("://")[0] + "://" + uri.split("://")[1].partition("/")[0] if "://" in uri else "file://"
    info = system.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
    named = lambda p: head + p if p.startswith("/") else uri.split("://")[0] + "://" + p
    return {named(f.path): f.size for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, glob)}


def _dealt(parts: list[tuple[str, int, int, bool]], size: int) -> list[ByteRanges]:
    """``parts`` of files cut at the ends of ranges and dealt to tasks, so that there are as many tasks as bytes ask for, not ranges."""
    dealt: list[ByteRanges] = []
    room = 0
    for path, start, stop, to_end in parts:
        while start < stop:
            if room < size or not dealt:
                dealt.append(ByteRanges([], size))
                room = max(size, TASK)
            cut = min(stop, start + room // size * size)
            dealt[-1].parts.append((path, start, cut, to_end and cut == stop))
            room -= max(cut - start, OPEN)
            start = cut
    return dealt


def _begin(file: pa.NativeFile, start: int) -> int:
    """Where the line begins that goes on at ``start``."""
    at, step = start, BACK
    while at > 0:
        low, step = max(0, at - step), min(2 * step, BLOCK)
        file.seek(low)
        found = file.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return 0


def _lines(file: pa.NativeFile, start: int, stop: int, to_end: bool) -> Iterator[tuple[int, bytes, bool]]:
    """(pos, line, whether it ended) of the lines whose line feed lies from ``start`` to before ``stop``."""
    # Without a line feed in the range there is nothing to look back for.
    began, pos, at = None, start, start
    parts: list[bytes] = []
    while at < stop:
        file.seek(at)
        block = file.read(min(BLOCK, stop - at))
        if not block:
            break
        at += len(block)
        pieces = block.split(b"\n")
        for n, piece in enumerate(pieces):
            parts.append(piece)
            if n == len(pieces) - 1:
                break
            line = b"".join(parts)
            if began is None:
                began = _begin(file, start)
                file.seek(began)
                line, pos = file.read(start - began) + line, began
            yield pos, line, True
            pos += len(line) + 1
            parts = []
    if to_end and (at > start or start == 0):
        line = b"".join(parts)
        if began is None:
            began = _begin(file, start)
            file.seek(began)
            line, pos = file.read(start - began) + line, began
        if line:
            yield pos, line, False


def _batches(task: ByteRanges) -> Iterator[pa.RecordBatch]:
    held: list[tuple[str, int, bytes, bool]] = []
    size = 0

    def sent() -> pa.RecordBatch:
        path, pos, line, ended = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(path), pa.array(pos, pa.int64()), pa.array(line, pa.binary()), pa.array(ended)], names=["path", "pos", "line", "ended"])

    for uri, start, stop, to_end in task.parts:
        system, path = _located(uri)
        with system.open_input_file(path) as file:
            for low in range(start, stop, task.size):
                high = min(stop, low + task.size)
                for row in _lines(file, low, high, to_end and high == stop):
                    held.append((uri, *row))
                    size += len(row[1])
                    if len(held) >= _LINES or size >= _SENT:
                        yield sent()
                        held, size = [], 0
    if held:
        yield sent()


class LineRanges(DataSource):
    """Options: path, a file or folder; glob of file names; bytes of a range."""

    @classmethod
    def name(cls) -> str:
        return "line_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Table(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


class _Table(DataSourceReader):
    def __init__(self, options):
        self.path, self.glob, self.size = options["path"], options.get("glob", "*.jsonl"), int(options.get("bytes", RANGE))

    def partitions(self) -> list[ByteRanges]:
        return _dealt([(path, 0, length, True) for path, length in sorted(_sizes(self.path, self.glob).items())], self.size)

    def read(self, partition: ByteRanges) -> Iterator[pa.RecordBatch]:
        return _batches(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.glob, self.size = options["path"], options.get("glob", "*.jsonl"), int(options.get("bytes", RANGE))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return _sizes(self.path, self.glob)

    def partitions(self, start: dict, end: dict) -> list[ByteRanges]:
        return _dealt([(path, start.get(path, 0), length, False) for path, length in sorted(end.items())], self.size)

    def read(self, partition: ByteRanges) -> Iterator[pa.RecordBatch]:
        return _batches(partition)


def json_line_ranges(spark: SparkSession, path: str, glob: str = "*.jsonl", size: int = RANGE, stream: bool = False) -> DataFrame:
    """(path, pos, line) of all non-blank lines under ``path``; pos is the byte at which a line begins.

    As ``sessions.json_lines``, but a file may be of any size: a last line without a line
    feed that is no valid JSON is left out; any other bad line raises when it is read.
    """
    spark.dataSource.register(LineRanges)
    read = (spark.readStream if stream else spark.read).format("line_ranges").option("path", path).option("glob", glob).option("bytes", str(size)).load()
    lines = read.select("path", "pos", F.decode("line", "UTF-8").alias("line"), "ended")
    parsed = F.try_parse_json("line")
    skipped = (F.trim("line") == "") | (parsed.isNull() & ~F.col("ended"))
    bad = parsed.isNull() | ~F.ltrim("line").startswith("{")
    said = F.concat("path", F.lit(" at byte "), F.col("pos").cast("string"), F.lit(": not a JSON object"))
    checked = F.when(skipped, None).when(bad, F.raise_error(said)).otherwise(F.col("line"))
    return lines.select("path", "pos", checked.alias("line")).where("line is not null")
