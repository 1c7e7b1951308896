"""Mixing sources to target weights by capped water-filling.

Every source asks for a share of the budget by weight; one that would pass its cap,
``max_epochs`` times its size, stays at the cap and the rest is shared again by
weight until none is above. Sorted by cap over weight, the sources that end at
their cap are a prefix, so running sums find the final level at once.

A source at ``rate`` epochs takes each document floor(rate) times whole. The rest of
the rate is met by taking documents once more in an order seeded by a hash of the
id, up to the point nearest to the target.

Scale: sources are summed map-side first, so a hot source is a few rows. The seeded
order is found without sorting a source in one place: hashes fall into ``BINS`` bins
for each source, running sums over the bins find the one where the target lies, and
only that bin's documents, a ``BINS``-th of the source, are numbered one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.shared import WORD, stored

SHARE, MAX_EPOCHS, WEIGHTS, SEED, BINS = 1.5, 2, (5, 2, 1), "mix-1", 65536


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``sources`` (source, source_size, weight) with target.

    The table has a row for each source, so its global window is small. Sizes and weights
    are not null; a null source is one like any other; sources of equal ratio go by name.
    A source of size 0 gets nothing, no sources give no rows.
    """
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    through = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped = sources.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    summed = capped.select(
        "*",
        (F.sum("cap").over(through) - F.col("cap")).alias("before"),
        F.sum("weight").over(rest).alias("open"),
        (F.sum("source_size").over(whole) * F.lit(float(share))).alias("budget"),
    )
    levelled = summed.withColumn("level", (F.col("budget") - F.col("before")) / F.col("open"))
    # The first source that does not reach its cap at its own level sets the level of all.
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    level = F.first(free, ignorenulls=True).over(whole)
    return levelled.select("source", "source_size", "weight", F.coalesce(F.least("cap", level * F.col("weight")), "cap").alias("target"))


def weighted_sources(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, weight): sources in code-point order, null last, take the weights in turn."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.pmod(place, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), turn.cast("int") + 1)
    return totals.select("source", "source_size", weight.cast("double").alias("weight"))


def _bin(seed: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.col("mark").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")


def _sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, mark, size): the mark tells rows without an id apart, by their texts."""
    mark = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("mark")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", mark, n_words(F.col("text")).alias("size"))


def _taken(sizes: DataFrame, share: float, max_epochs: float, weights: tuple[int, ...], seed: str) -> DataFrame:
    """The rows of ``sizes`` with source_size, target and times."""
    plan = stored(
        water_fill(weighted_sources(sizes, weights), share, max_epochs).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumn("epochs", F.floor("rate")).withColumn("goal", F.col("target") - F.col("epochs") * F.col("source_size")),
        "plan",
    )
    hashed = sizes.withColumn("hash", _bin(seed)).withColumn("bin", F.floor(F.col("hash") / F.lit(2**32 // BINS)).cast("int"))
    bins = hashed.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    running = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = bins.withColumn("before", F.sum("bin_size").over(running) - F.col("bin_size"))
    cut = upto.alias("u").join(plan.alias("p"), F.col("u.source").eqNullSafe(F.col("p.source"))).where("before < goal and goal <= before + bin_size").select("u.source", "bin", "before")
    cut = plan.alias("p").join(cut.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left").select("p.*", F.coalesce("c.bin", F.lit(-1)).alias("cut_bin"), F.coalesce("c.before", F.lit(0)).alias("cut_before"))
    placed = hashed.join(cut.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    inner = Window.partitionBy("source").orderBy("hash", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = placed.where("bin = cut_bin").withColumn("end", F.col("cut_before") + F.sum("size").over(inner))
    # Taken once more where that brings the sum nearer to the goal than leaving it out.
    edge = edge.withColumn("extra", (2 * F.col("goal") >= 2 * F.col("end") - F.col("size")).cast("int")).drop("end")
    rest = placed.where("bin != cut_bin").withColumn("extra", (F.col("bin") < F.col("cut_bin")).cast("int"))
    times = (F.col("epochs") + F.col("extra")).cast("long").alias("times")
    return edge.unionByName(rest).select("doc_id", "source", "mark", "size", "source_size", "target", times)


def mixed(docs: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, times), one row for each row of ``docs``.

    ``times`` is how often the mix takes the document. Reruns agree, whatever the
    partitions.

    Nulls: a null or empty text has size 0; null sources make a source of their own, the
    last in order; null ids are hashed by their texts. Texts of any length are counted
    whole. Rows with equal hashes are ordered by id, then size; rows alike in all three
    are interchangeable. A source of size 0 has target 0. Empty tables give empty
    results; other columns, whatever their names, are not read.
    """
    return _taken(stored(_sizes(docs), "sizes"), share, max_epochs, weights, seed).drop("mark")


def mix(docs: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; options are those of ``mixed``.

    Rows of a source that share a doc_id are taken together and equally often, and count
    with their common size. Nulls, long texts and empty tables are treated as by
    ``mixed``; all columns are carried along.
    """
    units = _sizes(docs).groupBy("doc_id", "source", "mark").agg(F.sum("size").alias("size"))
    times = _taken(stored(units, "units"), share, max_epochs, weights, seed).where("times > 0").select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("mark").alias("__mark"), F.col("times").alias("__times"))
    mark = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & docs["source"].eqNullSafe(F.col("__source")) & mark.eqNullSafe(F.col("__mark"))
    return docs.join(times, same).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)
