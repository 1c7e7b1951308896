"""Queries over trees, with regions, nations, suppliers, customers and orders as pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.operators import graph
from recollect.plans.common import table

FOLDER = "/home/me/rings/small-bolts/red_widget"


def _named(prefix, column):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _edges(spark, d):
    region = table(spark, d, "region").select(_named("R", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
    nation = table(spark, d, "nation").select(_named("N", "n_nationkey").alias("node"), _named("R", "n_regionkey").alias("parent"))
    supplier = table(spark, d, "supplier").select(_named("S", "s_suppkey").alias("node"), _named("N", "s_nationkey").alias("parent"))
    customer = table(spark, d, "customer").select(_named("C", "c_custkey").alias("node"), _named("N", "c_nationkey").alias("parent"))
    return region.union(nation).union(supplier).union(customer)


def tree_descendants(spark, d):
    below = graph.descendants(_edges(spark, d))
    return below.groupBy("root").agg(F.count("*").alias("nodes"), F.max("depth").alias("depth"))


def tree_depth(spark, d):
    return graph.ancestors(_edges(spark, d)).groupBy("node").agg(F.max("depth").alias("depth"))


def subject_rollup(spark, d):
    """Orders as observations of customers, rolled up to the top-level page; small subjects are left out."""
    roots = graph.ancestors(_edges(spark, d)).where("ancestor like 'R%'").select("node", F.col("ancestor").alias("subject"))
    orders = table(spark, d, "orders").select(_named("C", "o_custkey").alias("node"), "o_orderkey", "o_totalprice", F.col("o_orderstatus") == "P")
    orders = orders.toDF("node", "id", "rank", "covered").join(roots, "node")
    rolled = orders.groupBy("subject").agg(F.countDistinct("id").alias("observations"), F.max("rank").alias("best"), F.bool_or("covered").alias("covered"))
    return rolled.where("observations >= 3")


def visible_pages(spark, d):
    """Pages that hold an urgent order, or have a page below that does."""
    holding = table(spark, d, "orders").where("o_orderpriority like '1%'").select(_named("C", "o_custkey").alias("node"))
    roots = spark.range(1).select(F.lit("R0").alias("node"))
    return graph.visible(_edges(spark, d), holding, roots)


def heading_parents(spark, d):
    """The nearest shown page above each one, where every other nation is shown, and all regions."""
    edges = _edges(spark, d)
    shown = edges.where("node like 'R%' or (node like 'N%' and cast(substr(node, 2) as int) % 2 = 0)").select("node")
    return graph.nearest_included(edges, shown)


def cycle_check(spark, d):
    """Nations that each name another as parent; some of those run in circles."""
    key = F.col("n_nationkey")
    return graph.on_cycles(table(spark, d, "nation").select(key.alias("node"), F.pmod(key * key + 3, F.lit(25)).alias("parent")))


def folder_affinity(spark, d):
    """Part names as pages below their brand's page, matched with a folder's path."""
    parts = table(spark, d, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("page"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    scores = graph.folder_scores(F.lit(FOLDER), parts.select("page", "name"))
    edges = parts.select(F.col("brand").alias("node"), F.col("page").alias("parent")).groupBy("node").agg(F.min("parent").alias("parent"))
    return graph.affinity(scores, edges.unionByName(parts.select(F.col("page").alias("node"), F.lit(None).cast("string").alias("parent")))).select("page", F.round("affinity", 6).alias("affinity"))


QUERIES = {f.__name__: f for f in (tree_descendants, tree_depth, subject_rollup, visible_pages, heading_parents, cycle_check, folder_affinity)}

_EDGES = """edges(node, parent) AS (
  SELECT 'R' || r_regionkey, NULL FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer
), up(node, ancestor, depth) AS (
  SELECT node, node, 0 FROM edges
  UNION ALL
  SELECT up.node, edges.parent, depth + 1 FROM up JOIN edges ON edges.node = up.ancestor WHERE edges.parent IS NOT NULL
)"""

ORACLE_SQL = {
    "tree_descendants": f"WITH RECURSIVE {_EDGES} SELECT ancestor AS root, count(*) AS nodes, max(depth) AS depth FROM up GROUP BY ancestor",
    "tree_depth": f"WITH RECURSIVE {_EDGES} SELECT node, max(depth) AS depth FROM up GROUP BY node",
    "subject_rollup": f"""WITH RECURSIVE {_EDGES} SELECT ancestor AS subject, count(DISTINCT o_orderkey) AS observations, max(o_totalprice) AS best, bool_or(o_orderstatus = 'P') AS covered
FROM orders JOIN up ON node = 'C' || o_custkey AND ancestor LIKE 'R%' GROUP BY ancestor HAVING count(DISTINCT o_orderkey) >= 3""",
    "visible_pages": f"WITH RECURSIVE {_EDGES} SELECT DISTINCT ancestor AS node FROM up JOIN orders ON node = 'C' || o_custkey WHERE o_orderpriority LIKE '1%' UNION SELECT 'R0'",
    "heading_parents": f"""WITH RECURSIVE {_EDGES} SELECT node, arg_min(ancestor, depth) AS over FROM up
WHERE depth > 0 AND (ancestor LIKE 'R%' OR (ancestor LIKE 'N%' AND CAST(substr(ancestor, 2) AS INTEGER) % 2 = 0)) GROUP BY node""",
    "cycle_check": """WITH RECURSIVE e AS (SELECT n_nationkey AS node, (n_nationkey * n_nationkey + 3) % 25 AS parent FROM nation),
walk(node, tip, n) AS (SELECT node, parent, 1 FROM e UNION ALL SELECT walk.node, e.parent, n + 1 FROM walk JOIN e ON e.node = walk.tip WHERE n < 25)
SELECT DISTINCT node FROM walk WHERE node = tip""",
    "folder_affinity": f"""WITH parts AS (SELECT 'P' || p_partkey AS page, p_name AS name, p_brand AS brand, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS x FROM part),
segs AS (SELECT unnest(range(1, 6)) AS i, list_filter(string_split('{FOLDER}', '/'), lambda s: s <> '') AS l),
s AS (SELECT i, regexp_replace(lower(l[i]), '[^a-z0-9]', '', 'g') AS y, 0.85::DOUBLE ** (len(l) - i) AS w FROM segs WHERE i <= len(l)),
m AS (
  SELECT page, w, least(length(x), length(y)) AS short, 1 - levenshtein(x, y) / greatest(length(x), length(y)) AS base,
         len(list_filter(range(1, least(length(x), length(y)) + 1), lambda n: left(x, n) = left(y, n))) AS prefix
  FROM parts, s
), scores AS (
  SELECT page, max(w * CASE WHEN short < 3 THEN 0 WHEN prefix >= 5 AND prefix >= 0.6 * short THEN greatest(base, 0.8::DOUBLE) ELSE base END) AS score FROM m GROUP BY page
), e AS (SELECT brand AS node, min(page) AS parent FROM parts GROUP BY brand),
closure AS (SELECT page AS node, page AS ancestor, 0 AS depth FROM parts UNION ALL SELECT node, node, 0 FROM e UNION ALL SELECT node, parent, 1 FROM e)
SELECT node AS page, round(max(score / (depth + 1)), 6) AS affinity FROM closure JOIN scores ON page = ancestor WHERE score >= 0.7 GROUP BY node""",
}
