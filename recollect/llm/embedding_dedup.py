"""Near-duplicate vectors with an inverted multi-index.

Each half of a vector has a codebook of its own; a pair of codes, one of each, is a
cell of the product grid. A vector is stored in its nearest cell and asked in the
``visits`` nearest ones, in the order of the multi-sequence traversal. How many that
takes is measured: sample vectors are turned by exactly the least similarity in random
directions of the whole space and towards other sample vectors, which stays in the
span of the data, and ``QUERIES`` of them are multiplied with all rows for their true
links. The visits are those that meet ``RECALL`` of each kind in one direction; a pair
is found when either of the two meets the other. Every pair met is verified in double
precision.

Scale: equal vectors collapse first. The codebooks are fitted on at most
``SAMPLE`` vectors, taken by hash; those and the counts of true links by visits are
all that reaches the driver. A cell's
vectors and its askers are dealt into blocks of at most ``BLOCK``; a task multiplies
one block with one other and returns for each vector a count and one edge of a
spanning forest, not pairs, so dense groups give few rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.llm.components import connected_components
from recollect.llm.shared import stored

LEAST = 0.95
RECALL, SAMPLE, PER_CELL, MOST_CODES, BLOCK = 0.98, 20_000, 32, 512, 2048
#: Sample vectors turned, sample vectors whose true links are sought, and numbers that a traversal may hold at once.
TURNED, QUERIES, HELD = 4000, 256, 1 << 22


def _codebook(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means by Lloyd's rounds from distinct start points; empty codes stay where they are."""
    points = np.unique(points, axis=0)
    codes = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(10):
        near = _distances(points, codes).argmin(axis=1)
        sums = np.zeros_like(codes)
        np.add.at(sums, near, points)
        sizes = np.bincount(near, minlength=len(codes))
        codes[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return codes


def _distances(points: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (points**2).sum(axis=1)[:, None] - 2 * points @ codes.T + (codes**2).sum(axis=1)


class MultiIndex:
    """Codebooks for the halves of vectors of ``dim`` numbers, and the visits to make."""

    def __init__(self, sample: np.ndarray, k: int, least: float = LEAST, recall: float = RECALL, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.half = max(1, self.dim // 2)
        self.books = [_codebook(x, k, rng) for x in self._halves(sample)]
        self.visits = self._turned(sample, least, recall, rng)

    def _halves(self, units: np.ndarray) -> list[np.ndarray]:
        return [units[:, : self.half], units[:, self.half :]] if self.dim > 1 else [units, units]

    def cells(self, units: np.ndarray, visits: int) -> np.ndarray:
        """The first cells of the multi-sequence traversal, nearest first.

        Its first n steps can only reach ranks (a, b) with (a + 1) * (b + 1) <= n, so
        those few sums are sorted for all vectors at once in place of a heap for each.
        """
        sorted_halves = []
        for part, book in zip(self._halves(units), self.books, strict=True):
            d = _distances(part, book)
            order = np.argsort(d, axis=1, kind="stable")[:, :visits]
            sorted_halves.append((order, np.take_along_axis(d, order, axis=1)))
        (o1, d1), (o2, d2) = sorted_halves
        a, b = np.array([(a, b) for a in range(min(visits, o1.shape[1])) for b in range(min(visits // (a + 1), o2.shape[1]))]).T
        total = d1[:, a] + d2[:, b]
        first = np.argsort(total, axis=1, kind="stable")[:, :visits]
        return np.take_along_axis(o1[:, a] * len(self.books[1]) + o2[:, b], first, axis=1)

    def needed(self, units: np.ndarray, homes: np.ndarray) -> np.ndarray:
        """How many visits each vector makes until it meets its cell of ``homes``, ties counted in full."""
        (d1, d2) = (_distances(part, book) for part, book in zip(self._halves(units), self.books, strict=True))
        row = np.arange(len(units))
        most = d1[row, homes // len(self.books[1])] + d2[row, homes % len(self.books[1])]
        d2.sort(axis=1)
        return np.array([np.searchsorted(far, m - near + 1e-12, "right").sum() for near, far, m in zip(d1, d2, most, strict=True)], np.int64)

    def _turned(self, sample: np.ndarray, least: float, recall: float, rng: np.random.Generator) -> int:
        """The visits that meet ``recall`` of sample vectors turned by the least similarity.

        Random directions of the whole space and those towards other sample vectors
        are kinds of their own: where the spectrum decays the former leave the span.
        """
        x, visits = sample[:TURNED], 1
        for away in (rng.normal(size=x.shape), sample[rng.integers(len(sample), size=len(x))]):
            away = away - (away * x).sum(axis=1)[:, None] * x
            norms = np.linalg.norm(away, axis=1)
            far = norms > 1e-9
            if far.any():
                home = self.cells(least * x[far] + np.sqrt(1 - least**2) * away[far] / norms[far, None], 1)[:, 0]
                visits = max(visits, _quantile(self.needed(x[far], home), np.ones(int(far.sum())), recall))
        return visits


def _quantile(values: np.ndarray, weights: np.ndarray, share: float) -> int:
    """The least value that at least ``share`` of the weight does not exceed."""
    order = np.argsort(values)
    total = np.cumsum(weights[order])
    return int(values[order][np.searchsorted(total, share * total[-1] * (1 - 1e-12))])


def _units(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    flat /= np.abs(flat).max(axis=1)[:, None]
    return flat / np.linalg.norm(flat, axis=1)[:, None]


def _linked(index: MultiIndex, reps: np.ndarray, units: np.ndarray, least: float):
    """(query, visits, links) of a batch's rows (rep, copies, vector): true links of the queries by the visits that meet them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = pa.array(np.flatnonzero(np.asarray(batch.column(2).value_lengths()) == index.dim))
            if not len(fits):
                continue
            others, ids = _units(batch.column(2).take(fits)), np.asarray(batch.column(0).take(fits))
            q, m = np.nonzero(units @ others.T >= least)
            q, m = q[reps[q] != ids[m]], m[reps[q] != ids[m]]
            if not len(q):
                continue
            held = np.unique(m)
            home = index.cells(others[held], 1)[:, 0]
            pairs, n = np.unique(np.stack([q, home[np.searchsorted(held, m)]], axis=1), axis=0, return_counts=True)
            visits = np.concatenate([index.needed(units[x[:, 0]], x[:, 1]) for x in np.array_split(pairs, -(-len(pairs) // TURNED))])
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(visits, pa.int64()), pa.array(n, pa.int64())], names=["query", "visits", "links"])

    return run


def _visits_of_links(classes: DataFrame, index: MultiIndex, reps: np.ndarray, units: np.ndarray, least: float, recall: float) -> int:
    """The visits that meet ``recall`` of the queries' true links, counted by link and by query.

    Visits are counted in steps of a sixteenth, rounded up, so that few rows return.
    """
    found = classes.mapInArrow(_linked(index, reps, units, least), "query long, visits long, links long")
    step = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), F.floor(F.log2(F.col("visits").cast("double"))) - 4))
    rows = found.groupBy("query", (F.ceil(F.col("visits") / step) * step).cast("long").alias("visits")).agg(F.sum("links").alias("links")).collect()
    if not rows:
        return 1
    query, visits, links = np.array([tuple(r) for r in rows], np.int64).T
    share = links / np.bincount(query, links)[query]
    return min(max(_quantile(visits, links, recall), _quantile(visits, share, recall)), len(index.books[0]) * len(index.books[1]))


def _placed(index: MultiIndex):
    # A traversal looks at about visits * ln(visits) sums for each vector.
    step = max(1, int(HELD / (index.visits * (1 + np.log(index.visits)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(i, step) for x in batches for i in range(0, len(x), step)):
            vectors = batch.column(2)
            sizes = np.asarray(vectors.value_lengths())
            home = -sizes.astype(np.int64)
            visits: list = [[int(x)] for x in home]
            fits = np.flatnonzero(sizes == index.dim)
            if len(fits):
                cells = index.cells(_units(vectors.take(pa.array(fits))), index.visits)
                home[fits] = cells[:, 0]
                for i, found in zip(fits, cells, strict=True):
                    visits[i] = found
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int64()), pa.array(visits, pa.list_(pa.int64()))], names=["rep", "copies", "vector", "home", "visits"])

    return run


def _visited(visits: pa.ListArray, rows: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Of each pair of a row and a cell whether the cell is in the row's list."""
    asked = np.unique(rows)
    lists = visits.take(pa.array(asked))
    held = lists.flatten().to_numpy()
    known, place = np.unique(held, return_inverse=True)
    pairs = np.repeat(np.arange(len(asked)), np.asarray(lists.value_lengths())) * len(known) + place
    at = np.minimum(np.searchsorted(known, cells), max(len(known) - 1, 0))
    if not len(known):
        return np.zeros(len(rows), bool)
    return (known[at] == cells) & np.isin(np.searchsorted(asked, rows) * len(known) + at, pairs)


def _joined(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = pa.Table.from_batches(list(batches))
        asks = np.asarray(data["asks"])
        ids, copies, homes = (np.asarray(data[x]) for x in ("rep", "copies", "home"))
        units = _units(data["vector"].combine_chunks())
        q, m = np.flatnonzero(asks), np.flatnonzero(~asks)
        rows, cols = np.nonzero(units[q] @ units[m].T >= least)
        left, right = q[rows], m[cols]
        # A pair that meets in both directions counts where the smaller one asks.
        both = _visited(data["visits"].combine_chunks(), right, homes[left])
        counts = (ids[left] != ids[right]) & (~both | (ids[left] < ids[right]))
        left, right = ids[left[counts]], ids[right[counts]]
        size = dict(zip(ids.tolist(), copies.tolist(), strict=True))
        nodes, inverse = np.unique(np.concatenate([left, right]), return_inverse=True)
        a, b = inverse[: len(left)], inverse[len(left) :]
        weight = np.array([size[x] for x in nodes.tolist()], np.int64)
        links = np.zeros(len(nodes), np.int64)
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        label = np.arange(len(nodes))
        while len(a):
            low = label.copy()
            np.minimum.at(low, a, label[b])
            np.minimum.at(low, b, label[a])
            low = low[low]
            if (low == label).all():
                break
            label = low
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(links, pa.int64()), pa.array(nodes[label], pa.int64())], names=["id", "links", "label"])

    return run


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST, recall: float = RECALL) -> DataFrame:
    """(id_col, n_links, component_id, kept), one row for each row of ``vectors``.

    Links vectors whose cosine in double precision is at least ``least``.

    Nulls: a vector that is null, empty or zero, or holds a null or a non-finite
    number, links with nothing. A row with a null id links with nothing, has a null
    component_id and is kept. Vectors of another length than the sample's most
    common one have a cell for each length and are compared with all of that length.
    Equal vectors are rows of their own and link with each other; an id should name
    one vector. Pairs at the limit itself are linked; very long vectors are compared
    whole. Empty tables give empty results; other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    fit = F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False)))
    valid = rows.where("fit").select("id", "vector")
    classes = stored(valid.groupBy("vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).select("rep", "copies", "vector"), "classes")
    sample = [tuple(r) for r in classes.orderBy(F.xxhash64("rep", "vector")).limit(SAMPLE).select("rep", "vector").toLocalIterator()]
    if not sample:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    sizes = [len(x) for _, x in sample]
    dim = max(sorted(set(sizes)), key=sizes.count)
    points = _units(pa.array([x for _, x in sample if len(x) == dim], pa.list_(pa.float64())))
    reps = np.array([i for i, x in sample if len(x) == dim], np.int64)
    k = int(np.clip(round((classes.count() / PER_CELL) ** 0.5), 2, min(MOST_CODES, max(2, len(points) // 8))))
    index = MultiIndex(points, k, least, recall)
    index.visits = max(index.visits, _visits_of_links(classes, index, reps[:QUERIES], points[:QUERIES], least, recall))

    placed = stored(classes.mapInArrow(_placed(index), T.StructType([*classes.schema.fields, T.StructField("home", T.LongType()), T.StructField("visits", T.ArrayType(T.LongType()))])), "placed")
    inside = placed.groupBy(F.col("home").alias("cell")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("member_blocks"))
    asking = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("asker_blocks"))
    grid = inside.join(asking, "cell")
    place = F.abs(F.xxhash64("rep", F.lit(1)))
    asked = placed.select(F.explode("visits").alias("cell"), "rep", "copies", "vector", "home", F.lit(None).cast("array<long>").alias("visits")).join(grid, "cell")
    askers = asked.select("cell", F.explode(F.sequence(F.lit(0), F.col("member_blocks") - 1)).alias("mb"), F.pmod(place, "asker_blocks").cast("int").alias("ab"), F.lit(True).alias("asks"), "rep", "copies", "vector", "home", "visits")
    held = placed.withColumn("cell", F.col("home")).join(grid, "cell")
    members = held.select("cell", F.pmod(place, "member_blocks").cast("int").alias("mb"), F.explode(F.sequence(F.lit(0), F.col("asker_blocks") - 1)).alias("ab"), F.lit(False).alias("asks"), "rep", "copies", "vector", "home", "visits")
    found = stored(askers.union(members).groupBy("cell", "mb", "ab").applyInArrow(_joined(least), "id long, links long, label long"), "found")

    links = found.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    every = valid.join(classes, "vector").select("id", "rep", "copies")
    edges = found.select(F.col("id").alias("a"), F.col("label").alias("b")).union(every.select(F.col("id").alias("a"), F.col("rep").alias("b")))
    parts = connected_components(edges)
    alone = rows.where("not fit").select("id", F.lit(0).cast("long").alias("n_links"))
    counted = every.join(links, "rep", "left").select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return (
        counted.union(alone)
        .join(parts, "id", "left")
        .select(F.col("id").alias(id_col), "n_links", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
    )
