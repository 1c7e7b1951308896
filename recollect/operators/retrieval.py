"""Exact vector search, BM25, phrases, and their fusion by reciprocal rank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.functions.text import terms
from recollect.operators.tables import kept

#: Hits of each retriever, the constant of the fusion, hits in all.
CANDIDATES, RRF_K, MAX_HITS = 100, 60, 40
K1, B = 1.2, 0.75
#: Numbers of the vectors and of the queries that a task holds, and queries whose hits meet in one group.
HELD, ASKED, MERGED = 1 << 23, 1 << 20, 1024
#: Queries and vectors that are multiplied at once; products this far below the last hit may still be its equals.
TILE, SLACK = (512, 4096), 1e-12
_PACKED = "part int, query_ids binary, ids binary, scores binary"


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null for a zero vector or unequal lengths."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms)


def _exact(asked: np.ndarray, held: np.ndarray, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Cosines of pairs of columns, summed from the first number on, so that equal vectors tie wherever they lie."""
    scores = np.empty(len(rows))
    for low in range(0, len(rows), 1 << 16):
        r, p = rows[low : low + (1 << 16)], places[low : low + (1 << 16)]
        dot, left, right = np.zeros((3, len(r)))
        for x, y in zip(asked, held, strict=True):
            x, y = x[r].astype(np.float64), y[p].astype(np.float64)
            dot += x * y
            left += x * x
            right += y * y
        scores[low : low + len(r)] = np.clip(dot / np.sqrt(left * right), -1, 1)
    return scores


def _first(k: int, rows: np.ndarray, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of the k first of each row by ``order``, the last key first, sorted, and their places in the row from 0."""
    sorted_ = np.lexsort((*order, rows))
    r = rows[sorted_]
    new = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.empty(0, np.int64)
    place = np.arange(len(r)) - np.repeat(new, np.diff(np.r_[new, len(r)]))
    return sorted_[place < k], place[place < k]


def _top(asked: np.ndarray, held: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place, score) of the k rows of ``held`` of largest cosine for each of ``asked``, ties by place.

    Only products that reach the last hit so far are looked at; it moves on whenever twice as many vectors were met.
    """
    units = lambda x: x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    turned, columns = units(held).T, np.ascontiguousarray(held.T)
    for top in range(0, len(asked), TILE[0]):
        tile = asked[top : top + TILE[0]]
        own, own_columns = units(tile), np.ascontiguousarray(tile.T)
        rows = places = np.empty(0, np.int64)
        scores, least = np.empty(0), np.full(len(tile), -np.inf)
        at, stop = 0, max(2 * k, 1024)
        while at < len(held):
            met = []
            for low in range(at, min(stop, len(held)), TILE[1]):
                products = own @ turned[:, low : min(low + TILE[1], stop, len(held))]
                width = products.shape[1]
                if at == low == 0 and width > k:
                    least = np.partition(products, width - k, axis=1)[:, width - k]
                row, place = np.divmod(np.flatnonzero(products >= least[:, None] - SLACK), width)
                met.append((row, place + low))
            row, place = (np.concatenate(x) for x in zip(*met, strict=True))
            rows, places, scores = np.r_[rows, row], np.r_[places, place], np.r_[scores, _exact(own_columns, columns, row, place)]
            best, n = _first(k, rows, places, -scores)
            rows, places, scores = rows[best], places[best], scores[best]
            least = np.full(len(tile), -np.inf)
            least[rows[n == k - 1]] = scores[n == k - 1]
            at, stop = stop, 2 * stop
        yield rows + top, places, scores


def _best(k: int, parts: int):
    """The k best of a block of vectors for each of a block of queries, packed by the group in which a query's hits meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = pa.Table.from_batches(list(batches))
        asks, ids = np.asarray(data["asks"]), np.asarray(data["id"]).astype(np.int64)
        raw = data["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        del data
        q, v = np.flatnonzero(asks), np.flatnonzero(~asks)
        if not len(q) or not len(v):
            return
        v = v[np.argsort(ids[v], kind="stable")]
        rows, places, scores = (np.concatenate(x) for x in zip(*_top(raw[q], raw[v], k), strict=True))
        columns = [ids[q][rows], ids[v][places], scores]
        part = (columns[0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        told, starts = np.unique(part[order], return_index=True)
        for n, own in zip(told, np.split(order, starts[1:]), strict=True):
            packed = [pa.array([c[own].tobytes()], pa.binary()) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array([int(n)], pa.int32()), *packed], names=["part", "query_ids", "ids", "scores"])

    return run


def _ranked(k: int):
    """The k best of all that ``_best`` found for a query, ties by id."""
    kinds = (("query_ids", np.int64), ("ids", np.int64), ("scores", np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, kind) for _, kind in kinds]
        place = np.empty(0, np.int64)
        for batch in batches:
            held = [np.concatenate([x, *(np.frombuffer(b.as_buffer(), kind) for b in batch[name])]) for x, (name, kind) in zip(held, kinds, strict=True)]
            best, place = _first(k, held[0], held[1], -held[2])
            held = [x[best] for x in held]
        for low in range(0, len(place), 1 << 16):
            part = [pa.array(x[low : low + (1 << 16)]) for x in (*held, (place + 1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(part, names=["query_id", "id", "score", "rank"])

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int = CANDIDATES, scope: list[str] | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k vectors of largest cosine for each query, ties by id.

    ``queries`` has query_id and vector, ``vectors`` id and vector, both further the
    columns ``scope``, in which a query and its hits agree. Vectors that are null or
    zero, hold a null, NaN or infinite number, or have another length than the query, are no hits. Queries meet vectors in
    blocks of ``ASKED`` and ``HELD`` numbers, each task keeps its k best, and the best of those are ranked.
    """
    scope = scope or []

    def valid(df: DataFrame) -> DataFrame:
        return df.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & F.exists("vector", lambda x: x != 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))))

    sides = [queries.select(*scope, F.col("query_id").alias("id"), "vector"), vectors.select(*scope, "id", "vector")]
    sides = [x.where("size(vector) > 0").withColumn("dim", F.size("vector")) for x in sides]
    key = [*scope, "dim"]
    blocks = lambda numbers: F.ceil(F.count("*") * F.col("dim") / numbers).cast("int")
    sizes = [x.groupBy(*key).agg(blocks(numbers).alias(n)) for x, n, numbers in zip(sides, ("asked", "held"), (ASKED, HELD), strict=True)]
    grid = sizes[0].join(sizes[1], key)
    parts = []
    for asks, (side, own, other) in enumerate(((sides[1], "held", "asked"), (sides[0], "asked", "held"))):
        block = F.pmod(F.abs(F.xxhash64("id")), F.col(own)).cast("int")
        spread = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        placed = valid(side).join(grid, key).select(*key, "id", "vector", block.alias(f"b_{own}"), spread.alias(f"b_{other}"))
        parts.append(placed.select(*key, "b_asked", "b_held", F.lit(bool(asks)).alias("asks"), "id", "vector"))
    groups = -(-queries.count() // MERGED) or 1
    found = parts[0].union(parts[1]).groupBy(*key, "b_asked", "b_held").applyInArrow(_best(k, groups), _PACKED)
    return found.groupBy("part").applyInArrow(_ranked(k), "query_id long, id long, score double, rank int")


def postings(docs: DataFrame) -> DataFrame:
    """(id, term, tf) of ``docs`` (id, text)."""
    return docs.select("id", F.explode(terms(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def bm25(queries: DataFrame, docs: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """(query_id, id, score, rank): the k best documents by BM25, larger is better, ties by id.

    ``queries`` has query_id and text, of which each distinct term counts once; ``docs``
    id and text. Statistics cover all of ``docs``. A term that more than half of the
    documents hold counts next to nothing. Terms keep their diacritics.
    """
    # Each text is cut once: terms that no query has stop at the scan, the empty term,
    # which no text has, stands for the document itself.
    tokens = docs.select("id", terms(F.col("text")).alias("terms"))
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    wanted = asked.select("term").union(queries.sparkSession.createDataFrame([("",)], "term string")).distinct()
    found = tokens.select("id", F.size("terms").alias("size"), F.explode(F.array_append(F.coalesce("terms", F.array().cast("array<string>")), F.lit(""))).alias("term"))
    postings = kept(found.join(wanted, "term", "left_semi").groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("size").alias("size")))
    stats = postings.where("term = ''").agg(F.count("*").alias("n_docs"), F.avg(F.col("size").cast("double")).alias("avg_size"))
    held = postings.where("term != ''")
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = df.crossJoin(stats).select("term", "avg_size", F.when(idf <= 0, F.lit(1e-6)).otherwise(idf).alias("idf"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("avg_size")))
    hits = asked.join(weighed, "term").join(held, "term").groupBy("query_id", "id").agg(F.sum(part).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def _padded(text: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(terms(text), " "), F.lit(" "))


def phrase_hits(phrases: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, id): documents whose terms hold the phrase's terms in a row.

    Only documents that hold the phrase's rarest term are compared with it.
    """
    asked = phrases.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    held = docs.select("id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    df = asked.join(held.groupBy("term").agg(F.count("*").alias("df")), "term", "left")
    rarest = df.groupBy("query_id").agg(F.min_by("term", F.struct("df", "term")).alias("term"), F.bool_or(F.col("df").isNull()).alias("absent")).where("not absent")
    pairs = kept(rarest.join(held, "term").select("query_id", "id"))
    # Only texts that may hold a phrase are cut again.
    bodies = docs.join(pairs.select("id").distinct(), "id", "left_semi").select("id", _padded(F.col("text")).alias("body"))
    compared = pairs.join(bodies, "id").join(phrases.select("query_id", _padded(F.col("text")).alias("phrase")), "query_id")
    return compared.where(F.expr("contains(body, phrase)")).select("query_id", "id").distinct()


def named_pages(queries: DataFrame, names: DataFrame, least_bytes: int = 3) -> DataFrame:
    """(query_id, page): pages of whose names one occurs in a query as whole words.

    ``names`` has page and name. A name is looked up by its first term.
    """
    norm = F.array_join(terms(F.col("name")), " ")
    known = names.select("page", norm.alias("name"), terms(F.col("name"))[0].alias("term")).where(F.octet_length("name") >= least_bytes)
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    pairs = asked.join(known, "term").select("query_id", "page", "name")
    compared = pairs.join(queries.select("query_id", _padded(F.col("text")).alias("body")), "query_id")
    return compared.where(F.expr("contains(body, concat(' ', name, ' '))")).select("query_id", "page").distinct()


def fused(rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, id, rrf): the sum of 1 / (k + rank) over the retrievers, ranks from 1."""
    return rankings.groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"))


def with_bonus(scores: DataFrame, members: DataFrame, named: DataFrame, k: int = RRF_K) -> DataFrame:
    """``scores`` with 1 / (k + 1) more for each named page that an id is on.

    ``members`` has id and page. Ids found by name alone get their bonus as score.
    """
    bonus = named.join(members, "page").groupBy("query_id", "id").agg(F.count("*").alias("pages"))
    both = scores.join(bonus, ["query_id", "id"], "full")
    return both.select("query_id", "id", (F.coalesce("rrf", F.lit(0.0)) + F.coalesce("pages", F.lit(0)) / F.lit(float(k + 1))).alias("rrf"))


def relevance(scores: DataFrame) -> DataFrame:
    """``scores`` with the share of the query's best one."""
    return scores.withColumn("relevance", F.col("rrf") / F.max("rrf").over(Window.partitionBy("query_id")))


def search(vector_queries: DataFrame, text_queries: DataFrame, vectors: DataFrame, docs: DataFrame, limit: int = MAX_HITS) -> DataFrame:
    """(query_id, id, rrf, relevance, rank): both retrievers fused, best ``limit`` a query.

    An empty ``vector_queries`` leaves the lexical retriever alone.
    """
    both = nearest(vector_queries, vectors).select("query_id", "id", "rank").union(bm25(text_queries, docs).select("query_id", "id", "rank"))
    scored = relevance(fused(both))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf", 12)), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit)


def chunks_on_pages(evidence: DataFrame, observations: DataFrame, links: DataFrame, pages: DataFrame) -> DataFrame:
    """(chunk): chunks of ``evidence`` (chunk, observation) for a current observation on one of ``pages`` (page)."""
    on = links.join(pages.select("page"), "page", "left_semi").select("id").distinct()
    live = observations.where("replaced_by is null and forgotten is null").join(on, "id", "left_semi").select(F.col("id").alias("observation"))
    return evidence.join(live, "observation", "left_semi").select("chunk").distinct()


def layered(rankings: DataFrame, bonus: DataFrame | None = None, k: int = RRF_K) -> DataFrame:
    """(search_id, layer, id, rrf, relevance) of rankings (search_id, layer, id, rank), several for a search.

    ``bonus`` (search_id, layer, id, pages) adds 1 / (k + 1) for each named page. The
    best of a search over all layers has relevance 1.
    """
    found = rankings.groupBy("search_id", "layer", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"))
    if bonus is not None:
        both = found.join(bonus, ["search_id", "layer", "id"], "full")
        found = both.select("search_id", "layer", "id", (F.coalesce("rrf", F.lit(0.0)) + F.coalesce("pages", F.lit(0)) / F.lit(float(k + 1))).alias("rrf"))
    best = found.groupBy("search_id").agg(F.max("rrf").alias("best"))
    return found.join(best, "search_id").select("search_id", "layer", "id", "rrf", (F.col("rrf") / F.col("best")).alias("relevance"))


def search_layers(queries: DataFrame, layers: dict[str, tuple[DataFrame, DataFrame]], named: DataFrame | None = None) -> DataFrame:
    """(search_id, layer, id, rrf, relevance): both retrievers over all layers and queries of a search.

    ``queries`` has search_id, query_id, text and vector, null where there is none;
    ``layers`` a layer's vectors (id, vector) and texts (id, text). ``named`` is a bonus
    as for ``layered``.
    """
    asked = kept(queries)
    rankings = None
    for layer, (vectors, docs) in layers.items():
        ranked = nearest(asked.select("query_id", "vector"), vectors).select("query_id", "id", "rank").union(bm25(asked.select("query_id", "text"), docs).select("query_id", "id", "rank"))
        placed = ranked.join(asked.select("query_id", "search_id"), "query_id").select("search_id", F.lit(layer).alias("layer"), "id", "rank")
        rankings = placed if rankings is None else rankings.union(placed)
    return layered(rankings, named)


def to_vector(blob: Column) -> Column:
    """Little-endian 32-bit floats as an array; empty where the size is no multiple of four."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def decode(values: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
        whole = pa.array(sizes % 4 == 0)
        flat = np.frombuffer(b"".join(pc.fill_null(pc.if_else(whole, values, b""), b"").to_pylist()), "<f4")
        ends = np.cumsum(np.where(sizes % 4 == 0, sizes // 4, 0), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat, pa.float32()), mask=values.is_null())

    return decode(blob)


def to_blob(vector: Column) -> Column:
    @F.arrow_udf(T.BinaryType())
    def encode(values: pa.Array) -> pa.Array:
        data = pc.fill_null(values.flatten().cast(pa.float32()), float("nan")).to_numpy(zero_copy_only=False).astype("<f4").tobytes()
        ends = np.cumsum(4 * pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False))
        rows = [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return pa.array(rows, pa.binary(), mask=values.is_null().to_numpy(zero_copy_only=False))

    return encode(vector)
