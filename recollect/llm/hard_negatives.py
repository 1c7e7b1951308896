"""Hard negatives by threshold joins with norm bounds.

Vectors are scaled and floored to integers, so scores are exact. For each anchor the best
rows of its own label are its positives, and for each positive the best rows of other
labels whose score lies in a window below the positive's are its hard negatives.

Both are searched by one join of anchors with blocks of rows. A block keeps an inverted
index, dimension after dimension in the order of their weight in it. A row's last
dimensions, as many as its norm over them times the largest norm of an anchor over them
can't reach the least threshold, are left out of the index. Partial scores add up along
the postings; after each step pairs go whose partial score, together with the norms over
what is left, stays below the anchor's threshold; once few pairs are left, they are
followed one by one, to the end of their row.

Thresholds start high and are lowered until the windows fill: first the best score that a
sample of rows has in the window, then the last one that the window needs, which the
sample alone fills, then the window's own end. What a join returns at a threshold is
complete above it, so a window is done once it is full or its threshold is its end.

Scale: equal vectors of a label are one class with its smallest ids, so copies cost one
row. Anchors and classes are dealt by hash into blocks of bounded size; a task joins one
block of each and returns at most as many rows for a window as it can hold. Positives
meet only blocks of their label. The sample is one block and stays in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.shared import stored

#: Fixed by the contract: factor of the integers, positives of an anchor, negatives of a positive, and the window in
#: hundredths of the positive's score.
SCALE, POSITIVES, NEGATIVES, WINDOW = 256, 5, 3, (50, 95)
#: Anchors and classes of a block, classes of the sample, dimensions of a step, anchors that a task joins at once.
ANCHORS, MEMBERS, SAMPLE, STEP, AT_ONCE = 1024, 8192, 4096, 8, 128
#: The share of pairs below which they are followed one by one.
FEW = 0.05
#: Squared norms may reach this, so that a hundred times a score is a long; below EXACT doubles hold scores.
LARGEST, EXACT = 2.0**55, 2.0**52


def found_pairs(anchors: np.ndarray, rows: np.ndarray, least: np.ndarray, barred: np.ndarray | None = None, step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, row, score) of the pairs whose inner product is at least the anchor's ``least``, but for ``barred`` ones.

    ``least`` holds doubles, -inf for no threshold.
    """
    n_dims = rows.shape[1]
    square = lambda x: np.square(x.astype(np.float64))
    order = np.argsort(-square(rows).sum(axis=0), kind="stable")
    anchors, rows = anchors[:, order], rows[:, order]
    # Norms over what is left from each dimension on.
    rest = lambda x: np.sqrt(np.concatenate([np.cumsum(square(x)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(x), 1))], axis=1))
    rest_a, rest_r = rest(anchors), rest(rows)
    exact = max(rest_a[:, 0].max(initial=0), 1) * max(rest_r[:, 0].max(initial=0), 1) < EXACT
    anchors, rows = (x.astype(np.float64 if exact else np.int64) for x in (anchors, rows))
    lowest = least.min(initial=np.inf)
    # The index keeps a row's dimensions, in whole steps, as long as those from there on could reach the threshold.
    kept = (rest_r * rest_a.max(axis=0, initial=0) * (1 + 1e-9) + 0.5 >= lowest).sum(axis=1) if lowest > 0.5 else np.full(len(rows), n_dims)
    reach = (kept > 0) | (lowest <= 0.5)
    kept = np.minimum(-(-kept // step) * step, n_dims)
    by_length = np.argsort(-kept, kind="stable")
    rows, rest_r, kept, reach = rows[by_length], rest_r[by_length], kept[by_length], reach[by_length]
    barred = None if barred is None else barred[:, by_length]
    stops = [*range(step, n_dims, step), n_dims]
    for at in range(0, len(anchors), AT_ONCE):
        q, bound, need = anchors[at : at + AT_ONCE], rest_a[at : at + AT_ONCE], least[at : at + AT_ONCE, None]
        score = np.zeros((len(q), len(rows)), q.dtype)
        alive = np.tile(reach, (len(q), 1))
        if barred is not None:
            alive &= ~barred[at : at + AT_ONCE]
        done = 0
        for stop in stops:
            # Postings of these dimensions: the rows that have them come first.
            n = int((kept > done).sum())
            score[:, :n] += q[:, done:stop] @ rows[:n, done:stop].T
            alive[:, :n] &= (score[:, :n] + bound[:, stop, None] * rest_r[:n, stop]) + 0.5 + 1e-9 * bound[:, :1] * rest_r[:n, 0] >= need
            done = stop
            if alive[:, :n].sum() <= FEW * max(alive[:, :n].size, 1):
                break
        i, j = np.nonzero(alive)
        partial, start = score[i, j], np.minimum(kept[j], done)
        for begin, stop in zip([0, *stops[:-1]], stops, strict=True):
            behind = start <= begin
            if not behind.any():
                continue
            partial[behind] += np.einsum("nd,nd->n", q[i[behind], begin:stop], rows[j[behind], begin:stop])
            fits = ~behind | (partial + bound[i, stop] * rest_r[j, stop] * (1 + 1e-9) + 0.5 >= need[i, 0])
            i, j, partial, start = i[fits], j[fits], partial[fits], start[fits]
        hit = partial >= need[i, 0]
        yield i[hit] + at, by_length[j[hit]], partial[hit].astype(np.int64)


def _joined(same: bool, k: int):
    """(key, window, score, id) of the best ``k`` rows for each window of each anchor of a block among the classes of another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = pa.Table.from_batches(list(batches)).combine_chunks()
        asks, sizes = np.asarray(data["asks"]), np.asarray(data["vector"].combine_chunks().value_lengths())
        labels, key, own = (np.asarray(data[x]) for x in ("label", "key", "id"))
        ids, lows, highs = data["ids"].to_pylist(), data["lows"].to_pylist(), data["highs"].to_pylist()
        out: list[tuple] = []
        for size in np.unique(sizes):
            a, m = (np.flatnonzero((sizes == size) & side) for side in (asks, ~asks))
            if not len(a) or not len(m):
                continue
            of = lambda rows: data["vector"].combine_chunks().take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), -1 if size else 0)  # noqa: E731, B023
            least = np.array([min([float(x) for x in lows[i] if x is not None], default=np.inf) for i in a])
            barred = (labels[a][:, None] == labels[m]) != same
            for i, j, score in found_pairs(of(a), of(m), least, barred):
                by_anchor = np.argsort(i, kind="stable")
                i, j, score = i[by_anchor], j[by_anchor], score[by_anchor]
                first = np.searchsorted(i, np.arange(len(a) + 1))
                for x in np.unique(i):
                    js, ss = m[j[first[x] : first[x + 1]]], score[first[x] : first[x + 1]]
                    out += _in_windows(key[a[x]], own[a[x]], lows[a[x]], highs[a[x]], js, ss, ids, k)
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int32() if c == 1 else pa.int64()) for c in range(4)], names=["key", "window", "score", "id"])

    return run


def _in_windows(key: int, own: int, lows: list, highs: list, rows: np.ndarray, scores: np.ndarray, ids: list, k: int) -> list[tuple]:
    out = []
    for w, (low, high) in enumerate(zip(lows, highs, strict=True)):
        if low is None:
            continue
        inside = np.flatnonzero((scores >= low) & (scores <= high))
        # A class's first row stands before its others, so k classes, and the anchor's own, are enough.
        if len(inside) > k + 1:
            last = np.partition(-scores[inside], k)[k]
            inside = inside[-scores[inside] <= last]
        best = sorted((-int(scores[x]), i) for x in sorted(inside, key=lambda x: (-scores[x], ids[rows[x]][0]))[: k + 1] for i in ids[rows[x]] if i != own)[:k]
        out += [(key, w, -s, i) for s, i in best]
    return out


def _top(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("key", "window").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _join(asked: DataFrame, classes: DataFrame, same: bool, k: int, anchors: int, members: int) -> DataFrame:
    """The best ``k`` of each window of ``asked`` (key, id, label, vector, lows, highs) among all ``classes``."""
    part = [F.col("label") if same else F.lit(0).cast("long")]
    blocks = lambda df, n, name: df.groupBy(F.col("part")).agg(F.ceil(F.count("*") / n).cast("int").alias(name))
    asked, classes = asked.withColumn("part", part[0]), classes.withColumn("part", part[0])
    grid = blocks(asked, anchors, "asker_blocks").join(blocks(classes, members, "member_blocks"), "part")
    place = F.xxhash64("key", F.lit(3))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    none, cell = F.lit(None).cast("array<long>"), ["part", "ab", "mb"]
    askers = asked.join(grid, "part").select("part", F.pmod(place, "asker_blocks").cast("int").alias("ab"), upto("member_blocks").alias("mb"), F.lit(True).alias("asks"), "key", "id", "label", "vector", "lows", "highs", none.alias("ids"))
    held = classes.join(grid, "part").select("part", upto("asker_blocks").alias("ab"), F.pmod(place, "member_blocks").cast("int").alias("mb"), F.lit(False).alias("asks"), "key", F.lit(0).cast("long").alias("id"), "label", "vector", none.alias("lows"), none.alias("highs"), "ids")
    found = askers.union(held).groupBy(*cell).applyInArrow(_joined(same, k), "key long, window int, score long, id long")
    return _top(found, k)


def _filled(asked: DataFrame, classes: DataFrame, sample: DataFrame, same: bool, k: int, anchors: int, members: int) -> DataFrame:
    """(key, window, score, id, rank): the best ``k`` of each window, thresholds lowered until all are full or at their end.

    ``asked`` has one array of windows' lower ends (null: no window) and one of upper ends.
    """
    asked = stored(asked, "asked")
    seen = stored(_join(asked, sample, same, k, anchors, members), "sampled")
    if classes is sample:
        return seen
    # The best that the sample has in a window, then the last that the window needs, then its end.
    by_window = seen.groupBy("key", "window").agg(F.max("score").alias("best"), F.when(F.count("*") >= k, F.min("score")).alias("last"))
    ladder = stored(asked.select("key", F.posexplode("lows").alias("window", "low")).where("low is not null").join(by_window, ["key", "window"], "left"), "ladder")
    out = None
    for floor in ("best", "last", "low"):
        at = F.coalesce(floor, F.col("low"))
        steps = ladder.withColumn("at", at)
        lows = steps.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("window", "at"))).alias("ats"))
        now = asked.join(lows, "key").withColumn("lows", F.expr("transform(sequence(0, size(lows) - 1), w -> try_element_at(ats, w))")).drop("ats")
        found = stored(_join(now, classes, same, k, anchors, members), f"joined_{floor}")
        full = found.groupBy("key", "window").agg((F.count("*") >= k).alias("full"))
        judged = stored(steps.join(full, ["key", "window"], "left").withColumn("done", F.coalesce("full", F.lit(False)) | (F.col("at") == F.col("low"))), f"judged_{floor}")
        own = found.join(judged.where("done").select("key", "window"), ["key", "window"], "left_semi")
        out = own if out is None else out.unionByName(own)
        ladder = judged.where("not done").drop("at", "full", "done")
        if ladder.isEmpty():
            break
    return out


def _scaled(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(SCALE * x.cast("double")).cast("long"))


def hard_negatives(
    vectors: DataFrame,
    anchor: Column | None = None,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    sizes: tuple[int, int, int] = (ANCHORS, MEMBERS, SAMPLE),
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` tells by id which rows are anchors, those divisible by 50 unless told
    otherwise; an anchor's positives are the best ``positives`` other rows of its label, a
    positive's negatives the best ``negatives`` rows of other labels whose score is within
    ``WINDOW`` hundredths of the positive's. Of equal scores the smaller id comes first.

    Nulls: rows with a null id or label, a null vector, or one that holds a null or a
    non-finite number take no part, nor do those whose squared norm of integers passes
    2 ** 55, as a hundred times a score is to be a long. Vectors of different lengths are no partners.
    Rows equal in id, label and vector count once; rows that share an id only are rows of
    their own, but no partners of each other. Very long vectors are compared whole. Where
    a window holds fewer rows, all are returned, and none for an empty one, so a positive
    of a negative score has none. Empty tables give no rows; other columns are not read.
    """
    n_anchors, n_members, n_sample = sizes
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"))
    rows = rows.where("id is not null and label is not null and vector is not null")
    rows = rows.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))))
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.pow(F.floor(SCALE * x.cast("double")).cast("double"), 2.0))
    rows = rows.where(norm < LARGEST).withColumn("vector", _scaled(F.col("vector")))
    # Of a class of equal rows the first ids suffice: one more than can be asked for, as one may be the anchor.
    most = max(positives, negatives) + 1
    rows = rows.withColumn("hash", F.xxhash64("label", "vector"))
    place = F.row_number().over(Window.partitionBy("hash", "label", "vector").orderBy("id"))
    first = rows.dropDuplicates(["id", "hash", "label", "vector"]).withColumn("place", place).where(F.col("place") <= most)
    grouped = first.groupBy("hash", "label", "vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = stored(grouped.select(F.monotonically_increasing_id().alias("key"), "label", "vector", "ids"), "classes")
    small = classes.count() <= n_sample
    sample = classes if small else stored(classes.orderBy(F.xxhash64("label", "vector", F.lit(5))).limit(n_sample), "sample")
    asked = rows.where(anchor if anchor is not None else F.col("id") % 50 == 0).select("id", "label", "vector").distinct()
    asked = stored(asked.withColumn("key", F.monotonically_increasing_id()), "anchors")

    lowest = F.lit(-(2**63)).cast("long")
    one = asked.withColumns({"lows": F.array(lowest), "highs": F.array(F.lit(2**63 - 1).cast("long"))})
    near = stored(_filled(one, classes, sample, True, positives, n_anchors, n_members).select("key", F.col("score").alias("positive_score"), F.col("id").alias("positive_id"), (F.col("rank") - 1).alias("window")), "positives")
    score = F.col("positive_score")
    # Rounded up at the lower end and down at the upper one; a positive of a negative score has no window.
    low, high = F.expr(f"({WINDOW[0]} * positive_score + 99) div 100"), F.expr(f"{WINDOW[1]} * positive_score div 100")
    windows = near.where(score >= 0).select("key", F.struct("window", low.alias("low"), high.alias("high")).alias("w")).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("w.window", "w"))).alias("ws"))
    each = lambda field: F.expr(f"transform(sequence(0, {positives - 1}), i -> try_element_at(ws, i).{field})")
    many = asked.join(windows, "key").withColumns({"lows": each("low"), "highs": each("high")}).drop("ws")
    found = _filled(many, classes, sample, False, negatives, n_anchors, n_members)
    out = near.join(found.select("key", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["key", "window"]).join(asked.select("key", F.col("id").alias("anchor_id")), "key")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
