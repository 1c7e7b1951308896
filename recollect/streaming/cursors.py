"""Prefix cursors and seen messages as keyed state of a stream.

A unit of text is read again and again as it grows. The state of each unit is what was
taken of it so far: the length and hash of its content, the versions of it that still wait
to settle, and their timer. It lives in the stream's checkpoint, so a restarted stream goes
on where it stopped, and no table of cursors is read or written. Units that do not wait share
their state by buckets of paths, since a call for each unit costs a hundred times what it does.
Conversations keep the ids of the messages that were taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

_STORE = "spark.sql.streaming.stateStore.providerClass"
INCREMENT = "path string, status string, text string, length long, hash string, activity timestamp"
MESSAGE = "session string, id string, role string, timestamp string, text string"
#: Buckets of paths whose cursors are one state; a bucket's rows of a micro-batch are held at once.
BUCKETS = 1024
_CURSORS = pa.schema([("path", pa.string()), ("length", pa.int64()), ("hash", pa.string()), ("activity", pa.timestamp("ns"))])


@contextmanager
def state_store(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which several state variables need.

    ``partitions`` of the state are fixed by a checkpoint's first run; without them those of shuffles count.
    """
    wanted = {_STORE: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    if partitions is not None:
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)


def _millis(time: pd.Timestamp) -> int:
    return int(time.value // 1_000_000)


def _step(taken: tuple[int, str] | None, path: str, content: bytes, activity: pd.Timestamp) -> tuple[tuple, tuple]:
    """The row that tells of ``content``, and the cursor after it."""
    length, digest = len(content), hashlib.sha256(content).hexdigest()
    if taken is None:
        status, rest = "new", content
    elif length < taken[0] or hashlib.sha256(memoryview(content)[: taken[0]]).hexdigest() != taken[1]:
        status, rest = "rewritten", None
    else:
        status, rest = ("unchanged", None) if length == taken[0] else ("appended", content[taken[0] :])
    if rest is not None:
        taken = (length, digest)
    return (path, status, None if rest is None else rest.decode("utf-8", "replace"), length, digest, activity), (*taken, activity)


def _rows(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=[x.split()[0] for x in INCREMENT.split(", ")]).astype({"length": "int64", "activity": "datetime64[ns]"})


class PrefixCursors(StatefulProcessor):
    """Rows (path, activity, content) of a bucket of units to what each has beyond its unit's last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cursors = handle.getValueState("cursors", "packed binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        taken: dict[str, tuple] = {}
        if self.cursors.exists():
            with pa.ipc.open_stream(bytes(self.cursors.get()[0])) as packed:
                told = packed.read_all()
            moments = told["activity"].to_pandas()
            taken = {path: (length, digest, at) for path, length, digest, at in zip(told["path"].to_pylist(), told["length"].to_pylist(), told["hash"].to_pylist(), moments, strict=True)}
        units: dict[str, list[tuple]] = {}
        for df in rows:
            for path, activity, content in zip(df["path"], df["activity"], df["content"], strict=True):
                units.setdefault(path, []).append((activity, content or b""))
        out = []
        for path, versions in units.items():
            last = taken[path][2] if path in taken else None
            for activity, content in sorted(versions, key=lambda v: (v[0], len(v[1]))):
                # What came late is older than what was told.
                if last is None or not activity < last:
                    row, taken[path] = _step(taken[path][:2] if path in taken else None, path, content, activity)
                    out.append(row)
        columns = zip(*((path, *cursor) for path, cursor in taken.items()), strict=True)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _CURSORS) as packed:
            packed.write_table(pa.table([pa.array(c, f.type, from_pandas=True) for c, f in zip(columns, _CURSORS, strict=True)], schema=_CURSORS))
        self.cursors.update((sink.getvalue().to_pybytes(),))
        yield _rows(out)

    def close(self) -> None:
        pass


class SettlingCursor(StatefulProcessor):
    """Rows (path, activity, content) of one unit to what its newest version has beyond the last told.

    A version is told once the watermark is ``settle`` milliseconds past its activity; a newer one
    before that takes its place.
    """

    def __init__(self, settle: int):
        self.settle = settle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cursor = handle.getValueState("cursor", "length long, hash string, activity timestamp")
        self.waiting = handle.getValueState("waiting", "content binary, activity timestamp")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last = self.cursor.get()[2] if self.cursor.exists() else None
        newest = None
        for r in sorted((r for df in rows for r in df.itertuples(index=False)), key=lambda r: (r.activity, len(r.content or b""))):
            # What came late is older than what was told.
            if last is None or not r.activity < last:
                newest = r
        if newest is not None and (not self.waiting.exists() or self.waiting.get()[1] <= newest.activity):
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.waiting.update((newest.content or b"", newest.activity))
            self.handle.registerTimer(max(_millis(newest.activity) + self.settle, timerValues.getCurrentWatermarkInMs() + 1))
        yield _rows([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        content, activity = self.waiting.get()
        self.waiting.clear()
        taken = self.cursor.get()[:2] if self.cursor.exists() else None
        row, cursor = _step(taken, key[0], bytes(content), pd.Timestamp(activity))
        self.cursor.update(cursor)
        yield _rows([row])

    def close(self) -> None:
        pass


def increments(units: DataFrame, settle: float | None = None) -> DataFrame:
    """(path, status, text, length, hash, activity): what each version of a unit has beyond those before it.

    ``units`` is a stream of (path, activity, content); versions of a unit go by activity,
    and one older than what was told is passed over. A unit that still begins with
    what was taken of it is appended, or unchanged; any other change is rewritten, gives
    no text and leaves the cursor; the first version is new. With ``settle``, hours,
    a version is told once the watermark on activity is that far past it and none
    newer has come.
    """
    stream = units.select("path", F.col("activity").cast("timestamp").alias("activity"), F.col("content").cast("binary").alias("content"))
    if settle is None:
        bucket = F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).cast("int")
        return stream.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(PrefixCursors(), INCREMENT, "Append", "None")
    processor = SettlingCursor(int(settle * 3_600_000))
    return stream.withWatermark("activity", "0 seconds").groupBy("path").transformWithStateInPandas(processor, INCREMENT, "Append", "EventTime")


class SeenMessages(StatefulProcessor):
    """Messages of one session, each once; they wait until one of its user is among them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "id string", "n int")
        self.waiting = handle.getListState("waiting", MESSAGE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        fresh, spoken = [], False
        for df in rows:
            for r in df.itertuples(index=False):
                if r.id is not None and not self.seen.containsKey((r.id,)):
                    self.seen.updateValue((r.id,), (1,))
                    fresh.append(tuple(r))
                    spoken = spoken or r.role == "user"
        if spoken:
            fresh = [*(tuple(x) for x in self.waiting.get()), *fresh]
            self.waiting.clear()
        else:
            if fresh:
                self.waiting.appendList(fresh)
            fresh = []
        yield pd.DataFrame(fresh, columns=[x.split()[0] for x in MESSAGE.split(", ")], dtype=object)

    def close(self) -> None:
        pass


def new_messages(messages: DataFrame) -> DataFrame:
    """A stream's messages (session, id, role, timestamp, text) that were not seen before.

    A session's messages come out once a new one of its user is there; those without an id never.
    """
    columns = [x.split()[0] for x in MESSAGE.split(", ")]
    return messages.select(*columns).groupBy("session").transformWithStateInPandas(SeenMessages(), MESSAGE, "Append", "None")
