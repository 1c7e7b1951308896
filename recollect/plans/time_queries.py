"""Queries over days, periods and sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect.functions.calendar import parent_period, period_bounds, period_ids
from recollect.operators import timeline
from recollect.operators.fold import earlier_digests
from recollect.plans.common import table

TODAY, BEFORE = "2024-01-20", "1998-09-15"


def _days(spark, d):
    """Events by day, with a reach between 0 and 1."""
    return table(spark, d, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), "ts", "event_type", (F.col("value") / 500.0).alias("reach"))


def _order_days(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), "o_totalprice")


def period_rollup(spark, d):
    rolled = timeline.rolled_up(_order_days(spark, d), "day", "o_totalprice", "o_orderkey")
    return rolled.select("level", "period", "n_sources", F.round("weight", 2).alias("weight"), "last_seq")


def _periods(spark, d):
    """The distinct periods of all order days."""
    return timeline.periods_of(_order_days(spark, d).select("day").distinct(), "day").select("level", "period").distinct()


def bounds_of_periods(spark, d):
    start, stop = period_bounds(F.col("period"))
    return _periods(spark, d).select("period", F.date_format(start, "yyyy-MM-dd").alias("start"), F.date_format(stop, "yyyy-MM-dd").alias("stop"), parent_period(F.col("period")).alias("parent"))


def due_periods(spark, d):
    """Days with errors of large reach are pending; days before the 10th, and their weeks, are built."""
    events = _days(spark, d)
    spread = timeline.periods_of(events.select("day").distinct(), "day").select("period").distinct()
    pending = events.where("event_type = 'error' and reach > 0.45").select("day")
    start, stop = period_bounds(F.col("period"))
    built = spread.withColumn("stop", stop).where((F.col("stop") < F.to_date(F.lit("2024-01-10"))) & (F.col("period").startswith("day:") | F.col("period").startswith("week:"))).select("period")
    parents = spread.select(F.col("period").alias("child"), parent_period(F.col("period")).alias("period")).where("period is not null")
    return timeline.due(spread, F.to_date(F.lit(TODAY)), pending, built, parents)


def timeline_cover(spark, d):
    """Every period of the order days is built, but for odd months and weeks of large numbers."""
    built = _periods(spark, d).where(~F.col("period").rlike("^month:.*[13579]$") & ~F.col("period").rlike("^week:.*-3$")).select("period")
    return timeline.cover(_order_days(spark, d).select("day").distinct(), built, F.to_date(F.lit(BEFORE)))


def top_reach_per_period(spark, d):
    return timeline.top_of_period(_order_days(spark, d), "day", "o_totalprice", "o_orderkey").select("period", "o_orderkey", "rank")


def previous_day(spark, d):
    days = _order_days(spark, d).groupBy("day").agg(F.count("*").alias("n"))
    return timeline.previous_day(days, "n").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "previous")


def session_prev_next(spark, d):
    per = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.lag("event_id").over(per).alias("previous"), F.lead("event_id").over(per).alias("next"))


def session_earlier_digests(spark, d):
    entries = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")).alias("digest"))
    return earlier_digests(entries).select("seq", F.col("n_earlier").cast("int").alias("n_earlier"), "earlier_md5")


QUERIES = {f.__name__: f for f in (period_rollup, bounds_of_periods, due_periods, timeline_cover, top_reach_per_period, previous_day, session_prev_next, session_earlier_digests)}

_WEEK = "least(4, (day({d}) + 6) // 7)"
_IDS = f"""[{{'level': 'day', 'period': 'day:' || strftime(day, '%Y-%m-%d')}}, {{'level': 'week', 'period': 'week:' || strftime(day, '%Y-%m-') || least(4, (day(day) + 6) // 7)}},
  {{'level': 'month', 'period': 'month:' || strftime(day, '%Y-%m')}}, {{'level': 'year', 'period': 'year:' || strftime(day, '%Y')}}]"""
_ORDERS = "o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_totalprice FROM orders)"


def _spread(source: str) -> str:
    return f"spread AS (SELECT *, unnest({_IDS}) AS p FROM {source})"


_BOUNDS = """CASE WHEN period LIKE 'day:%' THEN CAST(substr(period, 5) AS DATE)
  WHEN period LIKE 'week:%' THEN CAST(substr(period, 6, 7) || '-01' AS DATE) + (CAST(right(period, 1) AS INTEGER) - 1) * 7
  WHEN period LIKE 'month:%' THEN CAST(substr(period, 7) || '-01' AS DATE) ELSE CAST(substr(period, 6) || '-01-01' AS DATE) END AS start,
 CASE WHEN period LIKE 'day:%' THEN CAST(substr(period, 5) AS DATE)
  WHEN period LIKE 'week:%-4' THEN last_day(CAST(substr(period, 6, 7) || '-01' AS DATE))
  WHEN period LIKE 'week:%' THEN CAST(substr(period, 6, 7) || '-01' AS DATE) + CAST(right(period, 1) AS INTEGER) * 7 - 1
  WHEN period LIKE 'month:%' THEN last_day(CAST(substr(period, 7) || '-01' AS DATE)) ELSE CAST(substr(period, 6) || '-12-31' AS DATE) END AS stop"""
_PARENT = f"""CASE WHEN period LIKE 'day:%' THEN 'week:' || substr(period, 5, 8) || {_WEEK.format(d='CAST(substr(period, 5) AS DATE)')}
  WHEN period LIKE 'week:%' THEN 'month:' || substr(period, 6, 7) WHEN period LIKE 'month:%' THEN 'year:' || substr(period, 7, 4) END"""

ORACLE_SQL = {
    "period_rollup": f"""WITH {_ORDERS}, {_spread('o')}
SELECT p.level AS level, p.period AS period, count(*) AS n_sources, round(sum(o_totalprice), 2) AS weight, max(o_orderkey) AS last_seq FROM spread GROUP BY 1, 2""",
    "bounds_of_periods": f"""WITH {_ORDERS}, {_spread('o')}, ids AS (SELECT DISTINCT p.period AS period FROM spread), b AS (SELECT period, {_BOUNDS}, {_PARENT} AS parent FROM ids)
SELECT period, strftime(start, '%Y-%m-%d') AS start, strftime(stop, '%Y-%m-%d') AS stop, parent FROM b""",
    "due_periods": f"""WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type, value / 500.0::DOUBLE AS reach FROM events), {_spread('e')},
ids AS (SELECT DISTINCT p.period AS period FROM spread), b AS (SELECT period, {_BOUNDS}, {_PARENT} AS parent FROM ids),
built AS (SELECT * FROM b WHERE stop < DATE '2024-01-10' AND (period LIKE 'day:%' OR period LIKE 'week:%'))
SELECT period FROM b WHERE stop < DATE '{TODAY}' AND period NOT IN (SELECT period FROM built)
  AND NOT EXISTS (SELECT 1 FROM e WHERE event_type = 'error' AND reach > 0.45 AND e.day BETWEEN b.start AND b.stop)
  AND NOT EXISTS (SELECT 1 FROM b c WHERE c.parent = b.period AND c.period NOT IN (SELECT period FROM built))""",
    "timeline_cover": f"""WITH {_ORDERS}, {_spread('(SELECT DISTINCT day FROM o)')},
w AS (SELECT CAST(date_trunc('month', DATE '{BEFORE}') AS DATE) + CAST(7 * ({_WEEK.format(d=f"DATE '{BEFORE}'")} - 1) AS INTEGER) - 1 AS before_week),
weeks AS (SELECT CAST(date_trunc('month', before_week) AS DATE) + CAST(7 * ({_WEEK.format(d="before_week")} - 1) AS INTEGER) AS last_week FROM w),
ok AS (
  SELECT day, p.period AS period, CASE p.level WHEN 'day' THEN 0 WHEN 'week' THEN 1 WHEN 'month' THEN 2 ELSE 3 END AS rank,
    CASE WHEN year(day) < year(DATE '{BEFORE}') - 1 THEN 3 WHEN day < date_trunc('month', DATE '{BEFORE}') - INTERVAL 1 MONTH THEN 2
         WHEN day < last_week THEN 1 ELSE 0 END AS allowed
  FROM spread, weeks WHERE day < DATE '{BEFORE}'
)
SELECT DISTINCT arg_max(period, rank) AS period FROM ok
WHERE rank <= allowed AND NOT regexp_matches(period, '^month:.*[13579]$') AND NOT regexp_matches(period, '^week:.*-3$') GROUP BY day""",
    "top_reach_per_period": f"""WITH {_ORDERS}, {_spread('o')},
r AS (SELECT p.level AS level, p.period AS period, o_orderkey, CAST(row_number() OVER (PARTITION BY p.period ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM spread WHERE p.level IN ('month', 'year'))
SELECT period, o_orderkey, rank FROM r WHERE rank <= CASE level WHEN 'month' THEN 10 ELSE 20 END""",
    "previous_day": f"""WITH {_ORDERS}, n AS (SELECT day, count(*) AS n FROM o GROUP BY day)
SELECT strftime(a.day, '%Y-%m-%d') AS day, a.n AS n, b.n AS previous FROM n a LEFT JOIN n b ON b.day = a.day - 1""",
    "session_prev_next": "SELECT event_id, lag(event_id) OVER w AS previous, lead(event_id) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "session_earlier_digests": """SELECT event_id AS seq, CAST(count(*) OVER w AS INTEGER) AS n_earlier, md5(coalesce(string_agg(event_type || ' ' || event_id, chr(10)) OVER w, '')) AS earlier_md5
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
}
