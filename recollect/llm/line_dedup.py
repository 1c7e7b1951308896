"""Line dedup with sharded cuckoo filters over exact reference counts.

The exact table has a row for each line key and document that holds it. Keys that
at least ``min_docs`` documents hold are repeated; each shard of the key space has a
cuckoo filter of its repeated keys. A document's lines are first asked of their
shard's filter, and only those that it lets through meet the exact counts. Inserting
or deleting documents changes rows of the exact table, and the keys that thereby
cross the limit are inserted into or deleted from the filters, so every insertion
can be undone.

Scale: lines travel as 16-byte hashes. A shard's lines are dealt by document over as many
tasks as they are millions, ``SPREAD`` at least, and each gets the shard's filter, so a
line that a third of all documents hold is dealt as well; a task holds one filter at a
time and streams the lines. What is let through meets its exact count by its key; the
at most ``HOT`` keys that hold more than one in ``HOT`` of all lines do so by a
broadcast, so no task gets more of one key than that. Counts are pre-aggregated before
the shuffle. Texts move once, to meet their own drops.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.llm.cuckoo import CuckooFilter, Full
from recollect.llm.shared import lean, stored

MIN_CHARS, MIN_DOCS = 40, 5
#: Repeated keys for each shard's filter, the least tasks that share a shard's lines and
#: the lines for each, and the most keys that are broadcast.
PER_SHARD, SPREAD, PER_TASK, HOT = 200_000, 8, 1_000_000, 10_000


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """16-byte hash of the stripped, lower-cased line; None if that is too short."""
    key = line.strip().lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _keys(min_chars: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                found = {line_key(x, min_chars) for x in (text.as_py() or b"").split(b"\n")} - {None}
                keys += found
                ids += [doc_id] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], names=["key", "doc_id"])

    return run


def _shard(n_shards: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(n_shards)).cast("int")


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard's new filter from its old one, if it has one, and its changes."""
    shard, made, added, gone = None, None, [], []
    for batch in batches:
        for row in batch.to_pylist():
            shard = row["shard"]
            if row["filter"] is not None:
                made = CuckooFilter.load(row["filter"])
            else:
                (added if row["added"] else gone).append(row["key"])
    full = False
    if made is None:
        made = CuckooFilter.of(added)
    else:
        try:
            for key in gone:
                made.delete(key)
            made.insert(*added)
        except Full:
            full = True
    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([None if full else made.dump()], pa.binary())], names=["shard", "filter"])


@lean
def _let_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of each shard that its filter, which comes before them, lets through."""
    shard, made = None, None
    for batch in batches:
        shards = batch.column(0).to_numpy()
        starts = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]) if len(shards) else []
        for start, end in zip(starts, np.r_[starts[1:], len(shards)] if len(shards) else [], strict=True):
            part = batch.slice(start, end - start)
            if shards[start] != shard:
                shard, made = shards[start], None
            heads = part.column(1)
            n = len(heads) - heads.null_count
            if n:
                made = CuckooFilter.load(heads[0].as_py())
                part = part.slice(n)
            if made is None or not len(part):
                continue
            keys = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(-1, 16)
            found = np.flatnonzero(made.contains(keys))
            if len(found):
                yield part.select([2, 3]).take(pa.array(found))


def _without(min_chars: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            at, drops_at = names.index("text"), names.index("__drops")
            texts, n_lines, n_dropped = [], [], []
            for text, drops in zip(batch.column(at).cast(pa.large_binary()), batch.column(drops_at).to_pylist(), strict=True):
                text = text.as_py()
                lines = (text or b"").split(b"\n")
                drops = set(drops or ())
                kept = [x for x in lines if line_key(x, min_chars) not in drops] if drops else lines
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
                texts.append(text if len(kept) == len(lines) else b"\n".join(kept))
            out = [pa.array(texts, pa.binary()).cast(pa.string()) if i == at else batch.column(i) for i in range(len(names)) if i != drops_at]
            yield pa.RecordBatch.from_arrays([*out, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*(x for x in names if x != "__drops"), "n_lines", "n_dropped"])

    return run


class LineIndex:
    """The exact table ``refs`` (key, doc_id) and the shards' ``filters``."""

    def __init__(self, refs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, filters: DataFrame | None = None, n_shards: int = 1):
        self.refs, self.min_chars, self.min_docs = refs, min_chars, min_docs
        self._repeated: DataFrame | None = None
        if filters is None:
            n_shards = max(1, -(-self.repeated().count() // PER_SHARD))
            changes = self.repeated().select(_shard(n_shards).alias("shard"), "key", F.lit(True).alias("added"))
            filters = _built(changes, None)
        self.filters, self.n_shards = filters, n_shards

    @staticmethod
    def of(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
        return LineIndex(_refs(docs, min_chars), min_chars, min_docs)

    def counts(self) -> DataFrame:
        """The reference count and the largest document of every key."""
        return self.refs.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last"))

    def repeated(self) -> DataFrame:
        """The keys of enough documents with their counts; written once."""
        if self._repeated is None:
            self._repeated = stored(self.counts().where(F.col("n_docs") >= self.min_docs), "repeated")
        return self._repeated

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with these documents too; ids already present gain their lines."""
        return self._moved(stored(self.refs.union(_refs(docs, self.min_chars)).distinct(), "refs"))

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index without the documents of ``ids`` (doc_id); unknown ids do nothing."""
        return self._moved(stored(self.refs.join(ids.select("doc_id"), "doc_id", "left_anti").select("key", "doc_id"), "refs"))

    def _moved(self, refs: DataFrame) -> LineIndex:
        plain = LineIndex(refs, self.min_chars, self.min_docs, self.filters, self.n_shards)
        now, was = plain.repeated().select("key"), self.repeated().select("key")
        added = now.join(was, "key", "left_anti").select(_shard(self.n_shards).alias("shard"), "key", F.lit(True).alias("added"))
        gone = was.join(now, "key", "left_anti").select(_shard(self.n_shards).alias("shard"), "key", F.lit(False).alias("added"))
        filters = _built(added.union(gone), self.filters)
        if filters.where("filter is null").limit(1).count():
            return LineIndex(refs, self.min_chars, self.min_docs)
        plain.filters = filters
        return plain

    def drops(self) -> DataFrame:
        """(doc_id, key): lines to drop from each document."""
        n_refs = self.refs.count()
        spread = max(SPREAD, -(-n_refs // (self.n_shards * PER_TASK)))
        lines = self.refs.select(_shard(self.n_shards).alias("shard"), F.lit(None).cast("binary").alias("filter"), "key", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(spread)).cast("int").alias("salt"))
        heads = self.filters.select("shard", "filter", F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("salt"))
        asked = (
            lines.union(heads)
            .repartition("shard", "salt")
            .sortWithinPartitions("shard", F.col("filter").isNull())
            .select("shard", "filter", "key", "doc_id")
            .mapInArrow(_let_through, "key binary, doc_id long")
        )
        # Each hot key holds more than a HOT-th of the lines, so there are at most HOT of them.
        hot = self.repeated().where(F.col("n_docs") > n_refs // HOT).select("key", F.col("last").alias("hot_last"))
        marked = asked.join(F.broadcast(hot), "key", "left")
        # What is settled goes on under a key of its own that matches nothing.
        met = F.when(F.col("hot_last").isNull(), F.col("key")).otherwise(F.encode(F.col("doc_id").cast("string"), "UTF-8")).alias("met")
        known = self.repeated().where(F.col("n_docs") <= n_refs // HOT).select(F.col("key").alias("met"), "last")
        settled = marked.select("key", "doc_id", "hot_last", met).join(known, "met", "left")
        return settled.where("doc_id != coalesce(hot_last, last)").select("doc_id", "key")


def _built(changes: DataFrame, filters: DataFrame | None) -> DataFrame:
    rows = changes.select("shard", "key", "added", F.lit(None).cast("binary").alias("filter"))
    if filters is not None:
        rows = rows.union(filters.select("shard", F.lit(None).cast("binary"), F.lit(None).cast("boolean"), "filter"))
    return stored(rows.groupBy("shard").applyInArrow(_filters, "shard int, filter binary"), "filters")


def _refs(docs: DataFrame, min_chars: int) -> DataFrame:
    keyed = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_keys(min_chars), "key binary, doc_id long")
    return stored(keyed.distinct(), "refs")


def without_repeated_lines(docs: DataFrame, index: LineIndex | None = None, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the repeated lines cut from text, and n_lines and n_dropped.

    A text is split at line feeds. A line's key is the line stripped of ASCII white
    space with A-Z lower-cased; keys of ``min_chars`` code points or more that
    ``min_docs`` documents or more hold lose their lines in all but the largest
    doc_id that holds them.

    Nulls: a null or empty text is one empty line and stays as it is. A row with a
    null doc_id neither counts nor loses lines. Rows that share a doc_id count as one
    document and lose the same lines. A line that a document holds several times counts
    once and goes or stays with all of them. Texts of any length are split whole. An empty
    table stays empty. Columns named n_lines or n_dropped are replaced; all others are
    carried along.
    """
    index = index or LineIndex.of(docs, min_chars, min_docs)
    drops = index.drops().groupBy("doc_id").agg(F.collect_list("key").alias("__drops"))
    docs = docs.drop("n_lines", "n_dropped")
    joined = docs.join(drops.withColumnRenamed("doc_id", "__id"), docs["doc_id"] == F.col("__id"), "left").drop("__id")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return joined.mapInArrow(_without(index.min_chars), schema)
