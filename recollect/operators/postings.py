"""A stored inverted index with positions, bounds of blocks, and segments that extend it.

Documents of a segment lie in blocks of about ``BLOCK``. A row of the index is a term in a
block: how many of its documents hold it, its largest frequency and their least size, and
the documents with their positions. The first columns alone bound what any document of
the block can score, so a search reads the lists of the best blocks, takes the score of
the last hit as threshold, and of the others reads only those whose bound reaches it.
Phrases meet by intersecting positions, shifted by the word's place in the phrase.

A segment is written before the next version of the manifest names it, and readers take
the newest version, so an index is never seen half extended, and a failed extension
leaves it as it was. Documents that are gone are kept in a list with the counts of
their terms, until ``merge`` writes one segment of all that is left.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.functions.text import terms
from recollect.operators.retrieval import CANDIDATES, K1, B
from recollect.operators.tables import kept

#: Documents of a block, query terms up to which their rows are read by a filter, and blocks that set a query's threshold.
BLOCK, FILTERED, LEADING = 1024, 500, 4
_POSTING = "term string, block int, n long, max_tf int, min_size int, entries array<struct<id:long,size:int,positions:array<int>>>"
_DOC = "id long, size int, terms array<string>"
_SEGMENT = "segment string, n_docs long, total_size long, gone boolean, upto long, version long"


def _inverted(ids: np.ndarray, words: pa.ListArray, block: int) -> pa.RecordBatch:
    """The index's rows of one block, by term; ``words`` of documents in the order of ``ids``."""
    sizes = words.value_lengths().to_numpy(zero_copy_only=False)
    encoded = words.flatten().dictionary_encode()
    by_term = pc.sort_indices(encoded.dictionary).to_numpy()
    place = np.empty(len(by_term), np.int64)
    place[by_term] = np.arange(len(by_term))
    term, doc = place[encoded.indices.to_numpy()], np.repeat(np.arange(len(ids)), sizes)
    at = (np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
    order = np.argsort(term, kind="stable")
    term, doc, at = term[order], doc[order], at[order]
    pair = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])])
    ends = np.r_[pair, len(term)].astype(np.int32)
    held = sizes[doc[pair]].astype(np.int32)
    first = np.flatnonzero(np.r_[True, np.diff(term[pair]) != 0])
    positions = pa.ListArray.from_arrays(pa.array(ends), pa.array(at))
    entries = pa.StructArray.from_arrays([pa.array(ids[doc[pair]]), pa.array(held), positions], names=["id", "size", "positions"])
    lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(pair)].astype(np.int32)), entries)
    most, least = np.maximum.reduceat(np.diff(ends), first), np.minimum.reduceat(held, first)
    counts = np.diff(np.r_[first, len(pair)])
    columns = [encoded.dictionary.take(pa.array(by_term)), pa.array(np.full(len(first), block, np.int32)), pa.array(counts), pa.array(most), pa.array(least), lists]
    return pa.RecordBatch.from_arrays(columns, names=["term", "block", "n", "max_tf", "min_size", "entries"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, block, words), sorted by block and id, to those of the index, block by block."""
    held: list[pa.RecordBatch] = []

    def told() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        words = pc.if_else(pc.is_valid(rows["words"]), rows["words"], pa.scalar([], pa.list_(pa.string()))).combine_chunks()
        words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
        if len(words.flatten()):
            yield _inverted(rows["id"].to_numpy(), words, rows["block"][0].as_py())

    for batch in batches:
        block = batch["block"].to_numpy()
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1), len(block)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if low == high:
                continue
            if held and held[0]["block"][0].as_py() != block[low]:
                yield from told()
                held = []
            held.append(batch.slice(low, high - low))
    if held:
        yield from told()


class Postings:
    """The index in a folder that the driver and all executors see."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def segments(self) -> list:
        """The manifest's newest version: a row for each segment."""
        told = self._table(f"{self.path}/manifest", _SEGMENT).collect()
        last = max((r["version"] for r in told), default=0)
        return [r for r in told if r["version"] == last]

    def _write_manifest(self, rows: list[tuple], version: int) -> None:
        self.spark.createDataFrame([(*r, version) for r in rows], _SEGMENT).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _of(self, segments: list, name: str, schema: str, gone: bool = False) -> DataFrame:
        """A table of all segments, with segment; its columns' names are those of the schema."""
        own = [s["segment"] for s in segments if s["gone"] == gone]
        if not own:
            return self.spark.createDataFrame([], f"{schema}, segment string")
        read = self.spark.read.schema(schema).parquet(*(f"{self.path}/{name}/{s}" for s in own))
        return read.withColumn("segment", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))

    def documents(self) -> DataFrame:
        """(id, size, terms) of what the index holds now."""
        segments = self.segments()
        return self._live(self._of(segments, "docs", _DOC), segments)

    def _live(self, rows: DataFrame, segments: list) -> DataFrame:
        gone = self._of(segments, "gone", "id long, of string", gone=True)
        if not any(s["gone"] for s in segments):
            return rows
        return rows.join(gone.select("id", F.col("of").alias("segment")), ["id", "segment"], "left_anti")

    def extend(self, docs: DataFrame, gone: DataFrame | None = None, upto: int | None = None) -> None:
        """Adds ``docs`` (id, text), each id once, and takes out those of ``gone`` (id) that were there before.

        ``upto`` is kept with the segment, as the place in the caller's log that it reaches.
        """
        before = self.segments()
        rows = [(s["segment"], s["n_docs"], s["total_size"], s["gone"], s["upto"]) for s in before]
        if gone is not None:
            name = uuid.uuid4().hex
            out = kept(self._live(self._of(before, "docs", _DOC), before).join(gone.select("id").distinct(), "id", "left_semi"))
            n, size = out.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
            if n:
                out.select("id", F.col("segment").alias("of")).write.parquet(f"{self.path}/gone/{name}")
                out.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).write.parquet(f"{self.path}/lost/{name}")
                rows.append((name, -n, -size, True, upto))
        name = uuid.uuid4().hex
        n, size = self._written(docs, name)
        if n:
            rows.append((name, n, size, False, upto))
        if len(rows) > len(before):
            self._write_manifest(rows, max((s["version"] for s in before), default=0) + 1)

    def _written(self, docs: DataFrame, name: str) -> tuple[int, int]:
        cut = docs.select(F.col("id").cast("long").alias("id"), terms(F.col("text")).alias("words"))
        cut = cut.select("id", F.coalesce("words", F.array().cast("array<string>")).alias("words"))
        forward = cut.select("id", F.size("words").alias("size"), F.array_distinct("words").alias("terms"))
        forward.write.option("compression", "zstd").parquet(f"{self.path}/docs/{name}")
        held = self.spark.read.schema(_DOC).parquet(f"{self.path}/docs/{name}")
        n, size = held.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        if not n:
            return 0, 0
        block = F.pmod(F.xxhash64("id"), F.lit(-(-n // BLOCK))).cast("int")
        # Texts are dealt by block, not their words: whoever holds a block makes all its rows. Files are sorted by term, so that readers skip what no query asks for.
        dealt = docs.select(F.col("id").cast("long").alias("id"), "text").withColumn("block", block).repartition("block").sortWithinPartitions("block", "id")
        rows = dealt.select("id", "block", terms(F.col("text")).alias("words")).mapInArrow(_blocks, _POSTING)
        rows.sortWithinPartitions("term", "block").write.option("compression", "zstd").parquet(f"{self.path}/postings/{name}")
        return n, size

    def merge(self) -> None:
        """One segment in place of all, without what is gone; texts are not needed, as the index has all positions."""
        before = self.segments()
        name = uuid.uuid4().hex
        live = kept(self._live(self._of(before, "docs", _DOC), before))
        n, size = live.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        rows = self._of(before, "postings", _POSTING).select("segment", "term", F.explode("entries").alias("e")).select("segment", "term", "e.*")
        rows = self._live(rows, before).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // BLOCK)))).cast("int"))
        entries = F.sort_array(F.collect_list(F.struct("id", "size", "positions")))
        merged = rows.groupBy("term", "block").agg(F.count("*").alias("n"), F.max(F.size("positions")).alias("max_tf"), F.min("size").alias("min_size"), entries.alias("entries"))
        live.drop("segment").write.parquet(f"{self.path}/docs/{name}")
        merged.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.parquet(f"{self.path}/postings/{name}")
        upto = max((s["upto"] for s in before if s["upto"] is not None), default=None)
        self._write_manifest([(name, n, size, False, upto)] if n else [], max((s["version"] for s in before), default=0) + 1)

    def _asked(self, asked: DataFrame, *tables: DataFrame) -> list[DataFrame]:
        """The rows of terms that are ``asked`` (term); few terms are pushed to the reader."""
        some = [r["term"] for r in asked.select("term").distinct().limit(FILTERED + 1).collect()]
        if len(some) <= FILTERED:
            return [table.where(F.col("term").isin(some)) for table in tables]
        return [table.join(asked.select("term").distinct(), "term", "left_semi") for table in tables]

    def bm25(self, queries: DataFrame, k: int = CANDIDATES, scope: DataFrame | None = None) -> DataFrame:
        """(query_id, id, score, rank): the k best documents by BM25, ties by id.

        ``queries`` has query_id and text, of which each distinct term counts once.
        Statistics cover all documents of the index; ``scope`` (id) limits the hits. A term
        that more than half of the documents hold counts next to nothing.
        """
        segments = self.segments()
        n_docs, total = sum(s["n_docs"] for s in segments), sum(s["total_size"] for s in segments)
        empty = "query_id long, id long, score double, rank int"
        if not n_docs:
            return self.spark.createDataFrame([], empty)
        average = total / n_docs
        asked = kept(queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")))
        postings, lost = self._asked(asked, self._of(segments, "postings", _POSTING), self._of(segments, "lost", "term string, n long", gone=True))
        heads = postings.select("term", "segment", "block", "n", "max_tf", "min_size")
        df = heads.select("term", "n").union(lost.select("term", -F.col("n"))).groupBy("term").agg(F.sum("n").alias("df")).where("df > 0")
        idf = F.ln((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weights = asked.join(df.select("term", F.when(idf <= 0, F.lit(1e-6)).otherwise(idf).alias("idf")), "term")

        def part(tf: Column, size: Column) -> Column:
            return F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / F.lit(average)))

        def scored(blocks: DataFrame | None) -> DataFrame:
            rows = weights.join(postings.select("term", "segment", "block", "entries"), "term") if blocks is None else blocks.join(weights, "query_id").join(postings.select("term", "segment", "block", "entries"), ["term", "segment", "block"])
            each = self._live(rows.select("query_id", "segment", "idf", F.explode("entries").alias("e")).select("query_id", "segment", "idf", "e.id", "e.size", F.size("e.positions").alias("tf")), segments)
            each = each if scope is None else each.join(scope.select("id").distinct(), "id", "left_semi")
            return each.groupBy("query_id", "segment", "id").agg(F.sum(part(F.col("tf"), F.col("size"))).alias("score"))

        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))
        if sum(-(-s["n_docs"] // BLOCK) for s in segments if not s["gone"]) <= LEADING:
            # All blocks would set the threshold.
            return scored(None).select("query_id", "id", "score").withColumn("rank", rank).where(F.col("rank") <= k)
        weights, heads = kept(weights), kept(heads)
        bounds = kept(weights.join(heads, "term").groupBy("query_id", "segment", "block").agg(F.sum(part(F.col("max_tf"), F.col("min_size"))).alias("bound")))
        place = Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "block")
        leading = kept(bounds.withColumn("place", F.row_number().over(place)).where(F.col("place") <= LEADING).drop("place"))
        first = kept(scored(leading.select("query_id", "segment", "block")))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"))
        threshold = first.withColumn("place", F.row_number().over(best)).where(F.col("place") == k).select("query_id", F.col("score").alias("least"))
        rest = bounds.join(leading.select("query_id", "segment", "block"), ["query_id", "segment", "block"], "left_anti").join(threshold, "query_id", "left")
        # Scores are compared rounded, so a bound just below the threshold may still tie.
        more = kept(rest.where("least is null or bound >= least - 1e-8").select("query_id", "segment", "block"))
        hits = first.union(scored(more)).select("query_id", "id", "score")
        return hits.withColumn("rank", rank).where(F.col("rank") <= k)

    def phrase_hits(self, phrases: DataFrame, score: bool = False) -> DataFrame:
        """(query_id, id): documents that hold the terms of ``phrases`` (query_id, text) in a row.

        Blocks that lack one of a phrase's terms are not read, nor documents that lack its
        rarest one. With ``score`` the phrase's BM25 follows, of which it is the one term.
        """
        segments = self.segments()
        asked = kept(phrases.select("query_id", F.posexplode(terms(F.col("text"))).alias("at", "term")))
        (postings,) = self._asked(asked, self._of(segments, "postings", _POSTING))
        heads = postings.select("term", "segment", "block", "n")
        distinct = asked.select("query_id", "term").distinct()
        wanted = distinct.groupBy("query_id").agg(F.count("*").alias("wanted"))
        met = distinct.join(heads, "term").groupBy("query_id", "segment", "block").agg(F.count("*").alias("met"), F.min_by("term", F.struct("n", "term")).alias("rarest"))
        blocks = kept(met.join(wanted, "query_id").where("met = wanted").select("query_id", "segment", "block", "rarest"))
        lists = postings.select("term", "segment", "block", "entries")
        rare = blocks.join(lists.withColumnRenamed("term", "rarest"), ["rarest", "segment", "block"]).select("query_id", "segment", F.explode("entries").alias("e")).select("query_id", "segment", "e.id")
        rare = kept(rare)
        rows = blocks.drop("rarest").join(asked, "query_id").join(lists, ["term", "segment", "block"]).select("query_id", "segment", "at", F.explode("entries").alias("e")).select("query_id", "segment", "e.id", "at", "e.size", "e.positions")
        rows = rows.join(rare, ["query_id", "segment", "id"], "left_semi")
        shifted = F.transform("positions", lambda p: p - F.col("at"))
        length = asked.groupBy("query_id").agg(F.count("*").alias("length"))
        # A document has one row for each word of a phrase.
        met = rows.groupBy("query_id", "segment", "id", "size").agg(F.collect_list(shifted).alias("starts")).join(length, "query_id").where(F.size("starts") == F.col("length"))
        common = F.aggregate(F.slice("starts", 2, F.greatest(F.col("length") - 1, F.lit(1)).cast("int")), F.element_at("starts", 1), lambda a, b: F.array_intersect(a, b))
        hits = self._live(met.select("query_id", "segment", "id", "size", F.size(common).alias("tf")).where("tf > 0"), segments)
        if not score:
            return hits.select("query_id", "id").distinct()
        n_docs, total = sum(s["n_docs"] for s in segments), sum(s["total_size"] for s in segments)
        hits = kept(hits)
        df = hits.groupBy("query_id").agg(F.count("*").alias("df"))
        idf = F.ln((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
        tf = F.col("tf")
        value = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("size") / F.lit(total / max(n_docs, 1))))
        return hits.join(df, "query_id").select("query_id", "id", value.alias("score"))


def name_hits(index: Postings, names: DataFrame, chosen: DataFrame) -> DataFrame:
    """(candidate, at, id): for each candidate the best phrase hit of its first name whose best hit is not chosen yet.

    ``names`` has candidate, at and name, in the order of at; ``chosen`` candidate and id.
    Of equally good hits the smaller id is the best. Candidates without such a name have no row.
    """
    asked = kept(names.select("candidate", "at", "name").withColumn("query_id", F.monotonically_increasing_id()))
    hits = index.phrase_hits(asked.select("query_id", F.col("name").alias("text")), score=True)
    best = hits.groupBy("query_id").agg(F.min(F.struct((-F.round("score", 9)).alias("less"), "id"))["id"].alias("id"))
    fresh = asked.join(best, "query_id").join(chosen.select("candidate", "id"), ["candidate", "id"], "left_anti")
    return fresh.groupBy("candidate").agg(F.min(F.struct("at", "id")).alias("x")).select("candidate", "x.at", "x.id")
