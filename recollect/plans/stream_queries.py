"""Queries that import events as a stream, and their sessions of activity."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from recollect.operators.tables import shared_folder
from recollect.plans.common import table
from recollect.streaming import sync

NOW = "2024-01-30 12:00:00"


def sync_exactly_once(spark, d):
    """Each user's numbers imported once, in two runs of which the second finds nothing new."""
    number = F.get_json_object("props", "$.k").cast("int")
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]").select("event_id", "user_id", number.alias("k"))
    folder = f"{shared_folder(spark)}/recollect-{uuid.uuid4().hex[:12]}"
    sync.sync(stream, ["user_id", "k"], "event_id", f"{folder}/log", f"{folder}/cursor")
    again = sync.sync(stream, ["user_id", "k"], "event_id", f"{folder}/log", f"{folder}/cursor")
    log = spark.read.parquet(f"{folder}/log")
    return log.groupBy("user_id").agg(F.count("*").alias("imported"), F.sum("k").alias("k_sum")).withColumn("imported_again", F.lit(again).cast("long"))


def settle_sessions(spark, d):
    spans = sync.active_spans(table(spark, d, "events").select("user_id", "ts"), "user_id", "ts")
    settled = sync.settled_spans(spans, F.lit(NOW))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return settled.select("user_id", stamp("start").alias("start"), stamp("stop").alias("stop"), "n")


QUERIES = {"sync_exactly_once": sync_exactly_once, "settle_sessions": settle_sessions}

ORACLE_SQL = {
    "sync_exactly_once": """WITH e AS (SELECT DISTINCT user_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
SELECT user_id, count(*) AS imported, CAST(sum(k) AS BIGINT) AS k_sum, 0::BIGINT AS imported_again FROM e GROUP BY user_id""",
    "settle_sessions": f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 3 HOUR THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS n_span FROM g), spans AS (SELECT user_id, min(ts) AS start, max(ts) AS stop, count(*) AS n FROM s GROUP BY user_id, n_span)
SELECT user_id, strftime(start, '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(stop, '%Y-%m-%d %H:%M:%S.%f') AS stop, n FROM spans WHERE stop <= TIMESTAMP '{NOW}' - INTERVAL 3 HOUR""",
}
