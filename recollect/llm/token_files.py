"""Token counts by scanning flat token files for end-of-document identifiers.

A token file is a run of little-endian identifiers of ``WIDTH`` bytes in which one
identifier ends every document; nothing else tells where documents begin. Files
are cut into blocks, and each block is searched at once for the positions of the
separator. A prefix scan over the blocks of a file, of a row each, carries on how
many documents ended before a block and where the last one did, which stitches
documents that lie across blocks.

Writing uses Spark's text writer: a row is a document's identifiers as bytes and the
line separator is the end identifier, so files appear through the same commit
protocol as any table, on any file system that Spark reaches.

Scale: no shuffle but the blocks' summaries and the final join of (file, ordinal) to
document ids. A block has ``BLOCK`` identifiers, whatever the length of a document. Files
are read once, end with ``PER_FILE`` documents, and must stay below Spark's 2 GB for a
value, which takes documents of 16,000 identifiers on average.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.llm.shared import shared_folder

WIDTH, BLOCK = 2, 1 << 20
#: Documents in a token file; a file is read whole by one task.
PER_FILE = 1 << 16


def rank_encoding(path: str, pattern: str):
    """A tiktoken encoding from a file of ranks; no text of its own becomes special."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _encoded(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = rank_encoding(path, pattern)
        for batch in batches:
            for start in range(0, len(batch), 256):
                texts = batch.column(0).slice(start, 256).to_pylist()
                ids = [np.array(encoding.encode_ordinary(t or ""), "<u2").tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], names=["ids"])

    return run


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, pattern: str, end: int, text_col: str = "text") -> None:
    """Writes a file for each partition of ``docs`` and ``PER_FILE`` rows, in the order of its rows."""
    ids = docs.select(text_col).mapInArrow(_encoded(vocabulary, pattern), "ids binary")
    separator = int(end).to_bytes(WIDTH, "little").decode("latin-1")
    ids.select(F.col("ids").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", separator).option("maxRecordsPerFile", PER_FILE).text(folder)


def _ends(end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends = [], []
            for value in batch.column(2):
                ids = np.frombuffer(value.as_buffer(), "<u2")
                sizes.append(len(ids))
                ends.append(np.flatnonzero(ids == end).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ends, pa.list_(pa.int32()))], names=["file", "block", "n", "ends"])

    return run


def scan_token_files(spark: SparkSession, folder: str, end: int, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, first, n_tokens, terminated), a row for each document in the files.

    ``ordinal`` and ``first``, the place of its first identifier, count from 0 in the
    file; n_tokens leaves out the end identifier. Identifiers after a file's last
    separator make a document that is not terminated; an empty file has none.
    """
    width = block * WIDTH
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    named = files.where("length > 0").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content", F.explode(F.sequence(F.lit(0), F.ceil(F.col("length") / width).cast("int") - 1)).alias("block"))
    blocks = named.select("file", "block", F.substring("content", F.col("block") * width + 1, F.lit(width)).alias("ids"))
    found = blocks.mapInArrow(_ends(end), "file string, block int, n long, ends array<int>")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = F.col("block").cast("long") * block
    last = F.when(F.size("ends") > 0, base + F.element_at("ends", -1))
    whole = Window.partitionBy("file")
    carried = found.select(
        "file",
        "ends",
        base.alias("base"),
        F.coalesce(F.sum(F.size("ends")).over(earlier), F.lit(0)).alias("before"),
        F.coalesce(F.max(last).over(earlier), F.lit(-1)).alias("last_end"),
        (F.col("block") == F.max("block").over(whole)).alias("is_last"),
        (base + F.col("n")).alias("upto"),
    )
    # Where each document of the block stops: at the ends found, and a file's last at its end.
    starts = F.concat(F.array(F.col("last_end") + 1), F.transform("ends", lambda at: F.col("base") + at + 1))
    stops = F.concat(F.transform("ends", lambda at: F.struct((F.col("base") + at).alias("stop"), F.lit(True).alias("terminated"))), F.when(F.col("is_last"), F.array(F.struct(F.col("upto").alias("stop"), F.lit(False).alias("terminated")))).otherwise(F.array()))
    placed = carried.select("file", "before", starts.alias("starts"), F.posexplode(stops).alias("i", "s"))
    documents = placed.select("file", (F.col("before") + F.col("i")).cast("long").alias("ordinal"), F.element_at("starts", F.col("i") + 1).alias("first"), "s.stop", "s.terminated")
    return documents.where("terminated or stop > first").select("file", "ordinal", "first", (F.col("stop") - F.col("first")).alias("n_tokens"), "terminated")


def token_counts(docs: DataFrame, vocabulary: str, pattern: str, end: int, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id_col, n_tokens, file, ordinal, first), one row for each row of ``docs``.

    The texts are written as token files into the shared folder and counted there.
    ``docs`` has to be a table as read, or a projection or filter of one: its rows are
    numbered in a second reading, in the same partitions and order as the files.

    Nulls: a null or empty text has no tokens and still an end; a null id is carried.
    Texts of any length are counted whole. Repeated rows are counted each. An empty table
    gives no rows; other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/recollect-{uuid.uuid4().hex[:12]}/tokens"
    write_token_files(docs, folder, vocabulary, pattern, end, text_col)
    numbered = docs.select(F.col(id_col), F.monotonically_increasing_id().alias("place"))
    row = F.col("place").bitwiseAND((1 << 33) - 1)
    numbered = numbered.select(id_col, F.shiftright("place", 33).alias("part"), F.floor(row / F.lit(PER_FILE)).cast("long").alias("piece"), F.pmod(row, F.lit(PER_FILE)).alias("ordinal"), F.lit(True).alias("read"))
    place = lambda n: F.regexp_extract("file", r"^part-(\d+)-.*-c(\d+)", n).cast("long")
    counted = scan_token_files(spark, folder, end, block).withColumn("part", place(1)).withColumn("piece", place(2))
    # A row without its tokens, or tokens without a row, would mean that the two readings differ.
    both = numbered.join(counted, ["part", "piece", "ordinal"], "full")
    checked = F.when(F.col("read").isNull() | F.col("n_tokens").isNull(), F.raise_error("the table was read in other partitions than its token files")).otherwise(F.col("n_tokens"))
    return both.select(id_col, checked.alias("n_tokens"), "file", "ordinal", "first")
