"""Trees, chains and redirects over edge tables.

Closures double: each step joins the pairs at the greatest depth so far with all pairs
found, so a tree takes as many steps as its depth has binary digits. What has been
reached is not found again, so cycles end. Where a caller gives a ``limit`` of levels,
a deeper tree is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.names import DEPTH_DISCOUNT, name_score
from recollect.operators.tables import kept

#: Pages that match a folder below this are no match; deepest heading of a brief.
MATCH, MAX_DEPTH = 0.7, 6


def ancestors(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """(node, ancestor, depth) of ``edges`` (node, parent), each node its own at depth 0.

    Null parents are roots. Where a node is reached on several ways, the shortest
    counts; in a cycle each node is an ancestor of the others once.
    """
    up = edges.select("node", F.col("parent").alias("ancestor")).where("node is not null and ancestor is not null and node != ancestor").distinct()
    nodes = edges.select("node").union(edges.select("parent")).where("node is not null").distinct()
    found = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth"))
    reach, new = 1, kept(up.withColumn("depth", F.lit(1)))
    while not new.isEmpty():
        if limit is not None and not new.where(F.col("depth") > limit).isEmpty():
            raise ValueError(f"the tree is deeper than {limit} levels")
        found = found.union(new)
        # A shortest way of more than ``reach`` levels passes a node at just that depth.
        first = new.where(F.col("depth") == reach).select("node", F.col("ancestor").alias("at"), F.col("depth").alias("before"))
        then = found.where("depth > 0").toDF("at", "ancestor", "after")
        step = first.join(then, "at").groupBy("node", "ancestor").agg(F.min(F.col("before") + F.col("after")).cast("int").alias("depth"))
        new = kept(step.join(found, ["node", "ancestor"], "left_anti"))
        reach *= 2
    return found


def descendants(edges: DataFrame, roots: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(root, node, depth): what lies below each of ``roots`` (node), all nodes by default.

    From given roots only what lies below them is walked, a level a step.
    """
    if roots is None:
        return ancestors(edges, limit).select(F.col("ancestor").alias("root"), "node", "depth")
    up = kept(edges.select("node", "parent").where("node is not null and parent is not null and node != parent").distinct())
    known = edges.select("node").union(edges.select("parent")).where("node is not null").distinct()
    new = kept(roots.select("node").distinct().join(known, "node", "left_semi").select(F.col("node").alias("root"), "node", F.lit(0).alias("depth")))
    found = new
    while not new.isEmpty():
        below = new.join(up.toDF("below", "node"), "node").select("root", F.col("below").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
        new = kept(below.join(found, ["root", "node"], "left_anti"))
        if limit is not None and not new.where(F.col("depth") > limit).isEmpty():
            raise ValueError(f"the tree is deeper than {limit} levels")
        found = found.union(new)
    return found


def predecessors(redirects: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, predecessor): all that was replaced, at once or by way of others, by each of ``asked`` (node)."""
    return descendants(redirects, asked).where("depth > 0").select(F.col("root").alias("node"), F.col("node").alias("predecessor"))


def cited(views: DataFrame, records: DataFrame) -> DataFrame:
    """(view, id and the columns of ``records``): what each of ``views`` (view, citations) cites, once each.

    Ids without a record are passed over. What a cited record cites itself is not opened.
    """
    return views.select("view", F.explode("citations").alias("id")).distinct().join(records, "id").where("view != id")


def on_cycles(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """(node): nodes that reach themselves."""
    up = edges.where("parent is not null").select("node", "parent").distinct()
    loops = up.where("node = parent").select("node")
    far = ancestors(edges, limit).where("depth > 0").select("node", F.col("ancestor").alias("at"))
    back = far.join(up.select(F.col("node").alias("at"), F.col("parent").alias("goal")), "at").where("goal = node").select("node")
    return loops.union(back).distinct()


def final_of(redirects: DataFrame, limit: int = 64) -> DataFrame:
    """(node, final) of replacement chains (node, parent): the end of each node's chain, its own for an end.

    Every step doubles the stretch of chain that a node has behind it, so a chain takes
    as many steps as its length has binary digits. A chain that runs in a circle has no
    end; its nodes are left out.
    """
    links = redirects.where("node is not null and parent is not null").select("node", "parent").distinct()
    at = kept(links.toDF("node", "at"))
    for _ in range(limit):
        ahead = at.toDF("at", "further")
        if at.join(ahead, "at", "left_semi").isEmpty():
            break
        step = at.join(ahead, "at", "left").select("node", F.coalesce("further", "at").alias("at"))
        at = kept(step.where("node != at").distinct())
    ends = links.select(F.col("parent").alias("at")).join(links.select(F.col("node").alias("at")), "at", "left_anti").distinct()
    return at.join(ends, "at", "left_semi").select("node", F.col("at").alias("final")).union(ends.select("at", F.col("at").alias("final")))


def redirected(df: DataFrame, redirects: DataFrame, *columns: str) -> DataFrame:
    """``df`` with the ids in ``columns`` followed to the end of their chains."""
    ends = kept(final_of(redirects))
    for c in columns:
        df = df.join(ends.toDF(c, "__final"), c, "left").withColumn(c, F.coalesce("__final", c)).drop("__final")
    return df


def visible(edges: DataFrame, holding: DataFrame, roots: DataFrame) -> DataFrame:
    """(node): pages that hold something or have a page below that does; ``roots`` always."""
    up = ancestors(edges).join(holding.select("node").distinct(), "node", "left_semi").select(F.col("ancestor").alias("node"))
    return up.union(roots.select("node")).distinct()


def nearest_included(edges: DataFrame, included: DataFrame) -> DataFrame:
    """(node, over): the nearest ancestor, not the node itself, that ``included`` (node) has."""
    over = ancestors(edges).where("depth > 0").join(included.select(F.col("node").alias("ancestor")), "ancestor", "left_semi")
    return over.groupBy("node").agg(F.min_by("ancestor", F.struct("depth", "ancestor")).alias("over"))


def folder_scores(folder: Column, pages: DataFrame) -> DataFrame:
    """(page, score) of ``pages`` (page, name) against a folder's path segments, best segment each.

    Segments further from the leaf count less.
    """
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    placed = pages.select("page", "name", F.posexplode(parts).alias("i", "part"), F.size(parts).alias("n"))
    discounted = name_score(F.col("part"), F.col("name")) * F.pow(F.lit(DEPTH_DISCOUNT), F.col("n") - 1 - F.col("i"))
    return placed.groupBy("page").agg(F.max(discounted).alias("score"))


def affinity(scores: DataFrame, edges: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """(page, affinity): page scores passed down the tree, each step down dividing more.

    Scores below ``MATCH`` are dropped; hidden pages take what is below them along.
    """
    closure = ancestors(edges)
    matched = scores.where(F.col("score") >= MATCH).withColumnRenamed("page", "ancestor")
    spread = closure.join(matched, "ancestor").groupBy("node").agg(F.max(F.col("score") / (F.col("depth") + 1)).alias("affinity"))
    if hidden is not None:
        below = closure.join(hidden.select(F.col("page").alias("ancestor")), "ancestor", "left_semi").select("node").distinct()
        spread = spread.join(below, "node", "left_anti")
    return spread.withColumnRenamed("node", "page")
