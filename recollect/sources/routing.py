"""Which home a unit goes to, by the longest root that its path starts with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def longest_prefix(units: DataFrame, path: str, routes: DataFrame) -> DataFrame:
    """``units`` with home, of the longest root of ``routes`` (root, home); null where none fits.

    Each different path meets the roots of the lengths that occur, by equality, so routes
    may be many; a path is compared with as many of its prefixes as there are lengths.
    Rows alike stay apart, other columns may be null, a column named home is replaced,
    and of a root's several homes the last in order counts.
    """
    paths = units.select(F.col(path).alias("__path")).where(F.col("__path").isNotNull()).distinct()
    # One row, of at most as many numbers as a path has characters.
    lengths = routes.select(F.length("root").alias("n")).distinct().agg(F.collect_list("n").alias("__lengths"))
    keyed = paths.crossJoin(lengths).select("__path", F.explode(F.filter("__lengths", lambda n: n <= F.length("__path"))).alias("__cut"))
    hits = keyed.withColumn("root", F.left("__path", F.col("__cut"))).join(routes.select("root", "home"), "root")
    best = hits.groupBy("__path").agg(F.max(F.struct("__cut", "home"))["home"].alias("home"))
    return units.drop("home").join(best, units[path] == F.col("__path"), "left").drop("__path")
