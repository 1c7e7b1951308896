"""Connected components of an edge table, without bringing edges to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.shared import fingerprint, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for each node that is not the smallest of its component.

    ``edges`` has the columns a and b. Large-star and small-star steps alternate
    until the edges form stars around each component's smallest id. A step is a
    minimum for each node, pre-aggregated before the shuffle, and a join that
    Spark may split where a node has very many edges; no node's edges are ever
    gathered in one place. Null ends and loops are left out; no edges give no rows.
    """
    a, b = F.col("a"), F.col("b")
    now = stored(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(),
        "edges",
    )
    seen = fingerprint(now, "a", "b")
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        roots = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(roots, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(roots.select("a", F.col("m").alias("b")))
        now = stored(small.distinct(), "edges")
        before, seen = seen, fingerprint(now, "a", "b")
        if before == seen:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
