"""Queries that derive the graph's state from a log of operations, with events as the log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect.operators import fold
from recollect.operators.graph import final_of, redirected
from recollect.plans.common import table
from recollect.sources.log import appended, dedup_key


def _ops(spark, d):
    """Events as operations: the target is user and number, the type says what is done."""
    number = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat_ws("/", F.col("user_id").cast("string"), (number % 10).cast("string")).alias("id"), "user_id", "event_type", "value", number.alias("k"), F.col("ts"))


def last_write_wins(spark, d):
    return fold.last_write(_ops(spark, d), ["id"], "seq", ["value", "event_type"])


def tombstones_current(spark, d):
    """Ids of signups that no later error forgot."""
    ops = _ops(spark, d)
    made = ops.where("event_type = 'signup'").groupBy("id").agg(F.max("seq").alias("seq"))
    forgets = ops.where("event_type = 'error'").join(made.withColumnRenamed("seq", "made"), "id").where("seq > made").select("id", "seq")
    observations = made.withColumn("replaced_by", F.lit(None).cast("string"))
    return fold.with_tombstones(observations, forgets).select("id", "seq", "forgotten", F.col("forgotten").isNull().alias("is_current"))


def _chains(spark, d):
    """Every entry of a user is replaced by the user's next one of the same type."""
    per = Window.partitionBy("user_id", "event_type").orderBy("seq")
    return _ops(spark, d).select(F.col("seq").alias("node"), F.lead("seq").over(per).alias("parent"), "user_id", "event_type").where("parent is not null")


def replacement_chain(spark, d):
    return final_of(_chains(spark, d).select("node", "parent"))


def lineage_inherit(spark, d):
    """The sources that each entry at the end of a chain has in the end."""
    links = _ops(spark, d).select(F.col("seq").alias("id"), F.col("k").alias("link"))
    return fold.inherited(links, _chains(spark, d).select("node", "parent")).groupBy("id").agg(F.count("*").alias("links"), F.sum("link").alias("link_sum"))


def patch_coalesce(spark, d):
    """Each entry of a user patches the one before: its value if it is large, its type always."""
    per = Window.partitionBy("user_id").orderBy("seq")
    ops = _ops(spark, d)
    fields = fold.patched(
        {"value": F.lag("value").over(per), "event_type": F.lag("event_type").over(per), "k": F.lag("k").over(per)},
        {"value": F.when(F.col("value") > 50, F.col("value")), "event_type": F.col("event_type")},
    )
    return ops.select("seq", *(c.alias(n) for n, c in fields.items()))


def stamp_conflict(spark, d):
    """Whether a user's entry before was written after the number of entries ago that this one saw."""
    per = Window.partitionBy("user_id").orderBy("seq")
    return _ops(spark, d).select("seq", fold.stamp_conflict(F.lag("seq").over(per), F.col("seq") - F.col("k") * 3).alias("conflict"))


def focus_state(spark, d):
    """Views hide and clicks show; the last of both counts for each user and id."""
    acts = _ops(spark, d).where(F.col("event_type").isin("view", "click"))
    return fold.focus_state(acts.select(F.col("user_id").alias("folder"), "id", "seq", F.when(F.col("event_type") == "view", "hide").otherwise("show").alias("action")))


def since_changes(spark, d):
    """Observations and pages that changed after half of the log, in the log's order."""
    ops = _ops(spark, d)
    half = ops.agg((F.max("seq") / 2).alias("half"))
    obs = fold.last_write(ops, ["id"], "seq", ["event_type"]).select(F.lit("observation").alias("what"), "id", "seq")
    pages = ops.groupBy(F.col("user_id").cast("string").alias("id")).agg(F.max("seq").alias("seq")).select(F.lit("page").alias("what"), "id", "seq")
    return obs.unionByName(pages).crossJoin(F.broadcast(half)).where("seq > half").select("what", "id", "seq")


def status_listing(spark, d):
    """Errors and clicks are failed attempts at the user's signup before them, purchases succeed."""
    per = Window.partitionBy("user_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ops = _ops(spark, d).withColumn("entry", F.max(F.when(F.col("event_type") == "signup", F.col("seq"))).over(per))
    log = ops.where("event_type = 'signup'").select("seq")
    tries = ops.where(F.col("entry").isNotNull() & F.col("event_type").isin("error", "click", "purchase")).select(F.col("entry").alias("seq"), F.col("seq").alias("attempt"), (F.col("event_type") == "purchase").alias("succeeded"), F.concat(F.lit("failed at "), F.col("seq").cast("string")).alias("message"))
    return fold.entry_status(log, tries)


def eligible_entries(spark, d):
    state = status_listing(spark, d).where("attempts > 0")
    return fold.eligible(_ops(spark, d).where("event_type = 'signup'").select("seq", "user_id"), state)


def redirect_merge(spark, d):
    """Suppliers as observations on nations as pages, of which each third is merged into the one before."""
    merges = table(spark, d, "nation").where("n_nationkey % 3 = 1").select(F.col("n_nationkey").alias("node"), (F.col("n_nationkey") - 1).alias("parent"))
    links = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("page"))
    return redirected(links, merges, "page").groupBy("page").agg(F.count("*").alias("observations"), F.min("id").alias("first_id"))


def log_append(spark, d):
    """The later half of the events appended to a log of the earlier one; numbers repeat as keys."""
    ops = _ops(spark, d)
    keyed = ops.select("seq", F.lit("note").alias("kind"), F.lit("user").alias("actor"), F.col("ts").alias("created"), "event_type", dedup_key(F.lit("note"), F.col("id")).alias("hash"))
    first = keyed.where("seq % 2 = 0").groupBy("hash").agg(F.min_by(F.struct("seq", "kind", "actor", "created", "event_type"), "seq").alias("x"))
    log = first.select("x.seq", "x.kind", "x.actor", "x.created", F.col("x.event_type").alias("payload"), "hash")
    batch = keyed.where("seq % 2 = 1").select(F.col("seq").alias("order"), "kind", "actor", "created", F.col("event_type").alias("payload"), "hash")
    return appended(log, batch)[1]


QUERIES = {
    f.__name__: f
    for f in (
        last_write_wins, tombstones_current, replacement_chain, lineage_inherit, patch_coalesce, stamp_conflict, focus_state,
        since_changes, status_listing, eligible_entries, redirect_merge, log_append,
    )
}

_OPS = """ops AS (
  SELECT event_id AS seq, user_id || '/' || (CAST(json_extract(props, '$.k') AS INTEGER) % 10) AS id, user_id, event_type, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k, ts FROM events
)"""
_CHAINS = "chains AS (SELECT * FROM (SELECT seq AS node, lead(seq) OVER (PARTITION BY user_id, event_type ORDER BY seq) AS parent FROM ops) WHERE parent IS NOT NULL)"
_FINAL = f"""WITH RECURSIVE {_OPS}, {_CHAINS}, walk(node, tip) AS (
  SELECT node, parent FROM chains
  UNION ALL
  SELECT walk.node, chains.parent FROM walk JOIN chains ON chains.node = walk.tip
), ends AS (SELECT node, max(tip) AS final FROM walk GROUP BY node), finals AS (SELECT node, final FROM ends UNION SELECT final, final FROM ends)"""
_STATUS = f"""WITH {_OPS}, marked AS (SELECT *, max(seq) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY seq) AS entry FROM ops),
told AS (
  SELECT entry, bool_or(event_type = 'purchase') AS done, count(*) AS n, max(seq) AS last FROM marked
  WHERE entry IS NOT NULL AND event_type IN ('error', 'click', 'purchase') GROUP BY entry
), status AS (
  SELECT seq, user_id, CASE WHEN done THEN 'done' WHEN n IS NOT NULL THEN 'failed' ELSE 'queued' END AS status, coalesce(n, 0) AS attempts,
         CASE WHEN NOT done AND n >= 3 THEN 'failed at ' || last END AS error
  FROM ops LEFT JOIN told ON entry = seq WHERE event_type = 'signup'
)"""

ORACLE_SQL = {
    "last_write_wins": f"WITH {_OPS} SELECT id, arg_max(value, seq) AS value, arg_max(event_type, seq) AS event_type, max(seq) AS seq FROM ops GROUP BY id",
    "tombstones_current": f"""WITH {_OPS}, made AS (SELECT id, max(seq) AS seq FROM ops WHERE event_type = 'signup' GROUP BY id),
gone AS (SELECT ops.id, min(ops.seq) AS forgotten FROM ops JOIN made ON made.id = ops.id AND ops.seq > made.seq WHERE event_type = 'error' GROUP BY ops.id)
SELECT made.id, seq, forgotten, forgotten IS NULL AS is_current FROM made LEFT JOIN gone ON gone.id = made.id""",
    "replacement_chain": f"{_FINAL} SELECT node, final FROM finals",
    "lineage_inherit": f"""{_FINAL}, links AS (SELECT seq AS id, k AS link FROM ops), every AS (SELECT * FROM links UNION SELECT final, link FROM links JOIN finals ON node = id)
SELECT id, count(*) AS links, CAST(sum(link) AS BIGINT) AS link_sum FROM every GROUP BY id""",
    "patch_coalesce": f"""WITH {_OPS} SELECT seq, coalesce(CASE WHEN value > 50 THEN value END, lag(value) OVER w) AS value, event_type, lag(k) OVER w AS k
FROM ops WINDOW w AS (PARTITION BY user_id ORDER BY seq)""",
    "stamp_conflict": f"WITH {_OPS} SELECT seq, coalesce(lag(seq) OVER (PARTITION BY user_id ORDER BY seq) > seq - k * 3, false) AS conflict FROM ops",
    "focus_state": f"WITH {_OPS} SELECT user_id AS folder, id FROM ops WHERE event_type IN ('view', 'click') GROUP BY 1, 2 HAVING arg_max(event_type, seq) = 'view'",
    "since_changes": f"""WITH {_OPS}, c AS (SELECT 'observation' AS what, id, max(seq) AS seq FROM ops GROUP BY id UNION ALL SELECT 'page', CAST(user_id AS VARCHAR), max(seq) FROM ops GROUP BY user_id)
SELECT what, id, seq FROM c WHERE seq > (SELECT max(seq) / 2 FROM ops)""",
    "status_listing": f"{_STATUS} SELECT seq, status, attempts, error FROM status",
    "eligible_entries": f"{_STATUS} SELECT seq, user_id FROM status WHERE status <> 'done' AND error IS NULL",
    "redirect_merge": """SELECT CASE WHEN s_nationkey % 3 = 1 THEN s_nationkey - 1 ELSE s_nationkey END AS page, count(*) AS observations, min(s_suppkey) AS first_id FROM supplier GROUP BY 1""",
    "log_append": f"""WITH {_OPS}, keyed AS (SELECT seq, event_type, sha256('note' || chr(0) || id) AS hash FROM ops),
log AS (SELECT hash, min(seq) AS seq, arg_min(event_type, seq) AS payload FROM keyed WHERE seq % 2 = 0 GROUP BY hash),
batch AS (SELECT seq AS "order", event_type AS payload, hash, row_number() OVER w = 1 AS lead, first_value(event_type) OVER w AS lead_payload FROM keyed WHERE seq % 2 = 1 WINDOW w AS (PARTITION BY hash ORDER BY seq)),
judged AS (SELECT b.*, l.seq AS old_seq, coalesce(l.payload, lead_payload) <> b.payload AS conflict FROM batch b LEFT JOIN log l USING (hash)),
fresh AS (SELECT hash, (SELECT max(seq) FROM log) + row_number() OVER (ORDER BY "order") AS new_seq FROM judged WHERE lead AND old_seq IS NULL AND NOT conflict)
SELECT "order", CASE WHEN NOT conflict THEN coalesce(old_seq, new_seq) END AS seq, NOT conflict AND (old_seq IS NOT NULL OR NOT lead) AS reused, conflict FROM judged LEFT JOIN fresh USING (hash)""",
}
