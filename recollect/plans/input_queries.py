"""Queries of files read by ranges of bytes, and of days that close while rows still come."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from recollect.operators.tables import kept, shared_folder
from recollect.plans.common import table
from recollect.sources.line_ranges import json_line_ranges
from recollect.streaming import cursors
from recollect.streaming.periods import built, day_versions, waiting

#: What arrives before each of these is a run's input; the day is forgotten in the last run.
CUTS, FORGOTTEN = ("2024-01-11", "2024-01-21"), "2024-01-10"
#: Bytes of a range: longer texts lie over several.
RANGE = 1 << 16


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/recollect-{uuid.uuid4().hex[:12]}"


def line_range_read(spark, d):
    """Documents written as JSON lines and read by ranges of bytes."""
    folder = _folder(spark)
    table(spark, d, "documents").select(F.to_json(F.struct("doc_id", "text")).alias("value")).write.text(folder)
    told = json_line_ranges(spark, folder, "part-*", RANGE).select(F.from_json("line", "doc_id long, text string").alias("d"))
    return told.select("d.doc_id", F.length("d.text").cast("long").alias("n_chars"), F.sha2("d.text", 256).alias("sha256"))


def closed_days(spark, d):
    """Events as a log in which errors arrive two days late, in three runs; a day is forgotten in the last one."""
    folder = _folder(spark)
    ts = F.col("ts").cast("timestamp")
    created = F.when(F.col("event_type") == "error", ts + F.expr("interval 2 days")).otherwise(ts)
    rows = kept(table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.date_format(ts, "yyyy-MM-dd").alias("day"), created.alias("created")))
    bounds = [None, *CUTS, None]
    newest = rows.agg(F.max("created").alias("created"))
    spark.createDataFrame([], "day string, created timestamp").write.parquet(f"{folder}/forgets/run=0")
    for run, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
        part = rows if low is None else rows.where(F.col("created") >= F.lit(low).cast("timestamp"))
        part = part if high is None else part.where(F.col("created") < F.lit(high).cast("timestamp"))
        part.write.parquet(f"{folder}/rows/run={run}")
        if high is None:
            newest.select(F.lit(FORGOTTEN).alias("day"), "created").write.parquet(f"{folder}/forgets/run={run}")
        stream = lambda name, schema: spark.readStream.schema(schema).parquet(f"{folder}/{name}/*")
        with cursors.state_store(spark):
            told = day_versions(stream("rows", "id string, day string, created timestamp"), stream("forgets", "day string, created timestamp"))
            query = told.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start()
            query.awaitTermination()
    told = spark.read.parquet(f"{folder}/out")
    waits = waiting(told).groupBy("day").agg(F.count("*").alias("n_waiting"))
    return built(told).groupBy("day", "version").agg(F.count("*").alias("n_built")).join(waits, "day", "left").select("day", "version", "n_built", F.coalesce("n_waiting", F.lit(0)).cast("long").alias("n_waiting"))


QUERIES = {"line_range_read": line_range_read, "closed_days": closed_days}

ORACLE_SQL = {
    "line_range_read": "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS sha256 FROM documents",
    "closed_days": f"""WITH e AS (SELECT CAST(ts AS DATE) AS d, CASE event_type WHEN 'error' THEN ts + INTERVAL 2 DAY ELSE ts END AS created FROM events),
r AS (SELECT *, CASE WHEN created < TIMESTAMP '{CUTS[0]}' THEN 0 WHEN created < TIMESTAMP '{CUTS[1]}' THEN 1 ELSE 2 END AS run FROM e),
w AS (SELECT n AS run, (SELECT max(created) FROM r WHERE run <= n) - INTERVAL 3 HOUR AS mark FROM range(3) t(n)),
f AS (SELECT d, min(run) AS first FROM r GROUP BY d),
c AS (SELECT d, min(run) AS closed FROM f JOIN w ON run >= first AND d + INTERVAL 1 DAY <= mark GROUP BY d),
v AS (SELECT *, CASE WHEN d = DATE '{FORGOTTEN}' AND closed < 2 THEN 2 ELSE 1 END AS version FROM c)
SELECT strftime(d, '%Y-%m-%d') AS day, CAST(version AS BIGINT) AS version, count(*) FILTER (version = 2 OR run <= closed) AS n_built, count(*) FILTER (version = 1 AND run > closed) AS n_waiting FROM r JOIN v USING (d) GROUP BY d, version""",
}
