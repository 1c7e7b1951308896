"""Counts, costs, listings and samples for people to read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.calendar import parsed_date
from recollect.operators.tables import kept, numbered

# Bands of reach, rows of each, the least directive and how many of those.
BANDS, PER_BAND, STRONG, N_STRONG = (0.7, 0.4), 3, 0.6, 2
MAX_PAGE, DEFAULT_PAGE = 100, 40
#: Pages of one observation up to which their pairs are made.
CROWD = 256


def calibration_sample(ratings: DataFrame) -> DataFrame:
    """The latest of each band of reach, and the latest strong directives, once each."""
    band = F.when(F.col("reach") >= BANDS[0], 2).when(F.col("reach") >= BANDS[1], 1).otherwise(0)
    latest = F.row_number().over(Window.partitionBy("band").orderBy(F.desc("id")))
    banded = ratings.withColumn("band", band).withColumn("n", latest).where(F.col("n") <= PER_BAND).select(*ratings.columns)
    strong = ratings.where(F.col("directive") >= STRONG).orderBy(F.desc("id")).limit(N_STRONG)
    return banded.union(strong).distinct()


def cost_by(calls: DataFrame) -> DataFrame:
    """(phase, model, tier, calls, cost)."""
    return calls.groupBy("phase", "model", "tier").agg(F.count("*").alias("calls"), F.sum("cost").alias("cost"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, (df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows") for name, df in tables.items()))


def present(happened: str, created: str, now: Column) -> Column:
    """An aggregate: the largest date text, as a time, no later than now.

    Texts are compared as texts, dates and times alike; what is neither counts as now.
    """
    latest = F.max(F.coalesce(happened, created))
    return F.least(F.coalesce(parsed_date(latest), now), now)


def page_inbound(links: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(page, observations, inbound) of links (id, page): the other pages that share an observation.

    Observations on at most ``crowd`` pages give their pairs of pages. Those on more are
    crowded: pages of the same set of them reach the same pages, so the union is made once
    for each set, of bitmaps over numbered pages, and for a set of one not even that. A
    page reached through a pair counts beside its set unless it shares a crowded
    observation too.
    """
    links = kept(links.select("id", "page").distinct())
    counts = links.groupBy("page").agg(F.count("*").alias("observations"))
    sizes = kept(links.groupBy("id").agg(F.count("*").alias("size")))
    few = links.join(sizes.where((F.col("size") > 1) & (F.col("size") <= crowd)).select("id"), "id", "left_semi")
    pairs = few.select("id", "page").join(few.select("id", F.col("page").alias("other")), "id").where("page != other").select("page", "other").distinct()
    crowded = sizes.where(F.col("size") > crowd)
    if crowded.isEmpty():
        inbound = pairs.groupBy("page").agg(F.count("*").alias("inbound"))
        return counts.join(inbound, "page", "left").select("page", "observations", F.coalesce("inbound", F.lit(0)).alias("inbound"))
    many = kept(links.join(crowded, "id"))
    sets = kept(many.groupBy("page").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.max("size").alias("size")))
    several = kept(sets.where(F.size("ids") > 1).select("ids").distinct().withColumn("set", F.monotonically_increasing_id()))
    places = numbered(sets.join(several, "ids", "left_semi").select("page").union(many.join(several.select(F.explode("ids").alias("id")).distinct(), "id", "left_semi").select("page")).distinct(), "n", "page")
    bitmaps = many.join(places, "page").groupBy("id", F.bitmap_bucket_number("n").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("pages"))
    unions = several.select("set", F.explode("ids").alias("id")).join(bitmaps, "id").groupBy("set", "bucket").agg(F.bitmap_or_agg("pages").alias("pages"))
    reached = several.join(unions.groupBy("set").agg(F.sum(F.bitmap_count("pages")).alias("reached")), "set").select("ids", "reached")
    # A page is among those that its own set reaches.
    through = sets.join(reached, "ids", "left").select("page", (F.coalesce("reached", "size") - 1).alias("through"))
    both = pairs.join(sets.select("page", "ids"), "page", "left").join(sets.select(F.col("page").alias("other"), F.col("ids").alias("others")), "other", "left")
    beside = both.where(~F.coalesce(F.arrays_overlap("ids", "others"), F.lit(False))).groupBy("page").agg(F.count("*").alias("beside"))
    found = counts.join(through, "page", "left").join(beside, "page", "left")
    return found.select("page", "observations", (F.coalesce("through", F.lit(0)) + F.coalesce("beside", F.lit(0))).alias("inbound"))


def page_of(df: DataFrame, order: list[Column], limit: int = DEFAULT_PAGE, offset: int = 0) -> DataFrame:
    """The rows from ``offset`` on, at most ``limit``, and on each whether there are more."""
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError(f"limit is 1 to {MAX_PAGE}, offset not negative")
    one_more = df.orderBy(*order).offset(offset).limit(limit + 1)
    n = F.row_number().over(Window.orderBy(*order))
    total = F.count("*").over(Window.partitionBy())
    return one_more.withColumn("__n", n).withColumn("more", total > limit).where(F.col("__n") <= limit).drop("__n")


def chunk_evidence(chunks: DataFrame, evidence: DataFrame, observations: DataFrame) -> DataFrame:
    """(id, reach, confidence, observations) of chunks: the best of their current observations.

    ``observations`` are current and rated. Chunks without any have reach 0.3 and
    confidence 0.5.
    """
    held = evidence.join(observations.select(F.col("id").alias("observation"), "reach", "confidence"), "observation")
    stats = held.groupBy("chunk").agg(F.max("reach").alias("reach"), F.max("confidence").alias("confidence"), F.count("*").alias("n"))
    joined = chunks.select("id").join(stats.withColumnRenamed("chunk", "id"), "id", "left")
    return joined.select("id", F.coalesce("reach", F.lit(0.3)).alias("reach"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.coalesce("n", F.lit(0)).alias("observations"))


def linked_lists(observations: DataFrame, **links: DataFrame) -> DataFrame:
    """``observations`` with a sorted array for each of ``links`` (id, value); empty without any."""
    for name, df in links.items():
        lists = df.groupBy("id").agg(F.sort_array(F.collect_set("value")).alias(name))
        observations = observations.join(lists, "id", "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
    return observations
