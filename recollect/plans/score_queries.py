"""Queries that score, rate, report and rank."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect.functions import scoring as s
from recollect.operators import reports
from recollect.operators.validation import rated, stale_ratings
from recollect.plans.common import table

NOW = "2024-01-31 00:00:00"


def _entries(spark, d):
    """Events as log entries: purchases are sources whose payload has a kind, clicks are users' notes."""
    kinds = F.array(*map(F.lit, s.SOURCE_PRIORS))
    number = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", number.alias("k"),
        s.source_kind(F.when(F.col("event_type").isin("purchase", "view"), "source").otherwise("note"), F.when(F.col("event_type") == "click", "user").otherwise("agent"), F.element_at(kinds, F.pmod(number, F.lit(7)) + 1)).alias("kind"),
    )


def freshness_decay(spark, d):
    fresh = s.freshness(F.col("ts"), F.lit(NOW).cast("timestamp"), F.when(F.col("event_type") != "error", 1.0 + F.col("k") % 9))
    return _entries(spark, d).select("event_id", F.round(fresh, 6).alias("freshness"))


def source_kind_case(spark, d):
    return _entries(spark, d).select("event_id", "kind", s.source_prior(F.col("kind")).alias("prior"))


def _variables():
    """Ratings and other variables of an entry, some left to their defaults."""
    return {
        "reach": F.least(F.col("value") / 200.0, F.lit(1.0)),
        "surprise": F.when(F.col("k") % 3 != 0, F.col("k") / 100.0),
        "directive": (F.col("k") % 5) / 10.0,
        "confidence": F.when(F.col("k") % 4 != 0, 0.5 + F.col("k") / 200.0),
        "freshness": s.freshness(F.col("ts"), F.lit(NOW).cast("timestamp"), F.lit(14.0)),
        "source_prior": s.source_prior(F.col("kind")),
        "sources": 1.0 + F.col("k") % 6,
        "relevance": F.col("k") / 97.0,
    }


def standing_score(spark, d):
    rank = s.score("standing", **_variables()) * s.STANDING_BOOST
    return _entries(spark, d).select("event_id", F.round(rank, 6).alias("score"), s.bucket(rank).alias("bucket"))


def situational_score(spark, d):
    v = _variables()
    v["relevance"] = v["relevance"] * s.SITUATIONAL_BOOST
    return _entries(spark, d).select("event_id", F.round(s.score("situational", **v), 6).alias("score"))


def chunk_score(spark, d):
    """Entries as chunks of their user: the user's best reach, the entry's own relevance."""
    v = _variables()
    best = F.max(v["reach"]).over(Window.partitionBy("user_id"))
    return _entries(spark, d).withColumn("best", best).select("event_id", F.round(s.score("chunk", relevance=v["relevance"], reach=F.col("best"), source_prior=v["source_prior"]), 6).alias("score"))


def page_score(spark, d):
    """Users as pages: their best entry and how many they have; inbound are the kinds they share."""
    per = _entries(spark, d).groupBy("user_id").agg(F.max(_variables()["reach"]).alias("best"), F.count("*").alias("n"), F.countDistinct("kind").alias("kinds"))
    return per.select("user_id", F.round(s.score("page", best=F.col("best"), observations=F.col("n"), inbound=F.col("kinds")), 6).alias("score"))


def source_prior_max(spark, d):
    return _entries(spark, d).groupBy("user_id").agg(F.max(s.source_prior(F.col("kind"))).alias("prior"), F.count("*").alias("sources"))


def _observations(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("line"))


def _ratings(spark, d):
    """Labels as ratings of the line that each third document had before."""
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("line"))
    labels = table(spark, d, "labels").join(docs, "doc_id")
    line = F.when(F.col("doc_id") % 3 == 0, F.lit("an older line")).otherwise(F.col("line"))
    return labels.select(F.col("doc_id").alias("id"), line.alias("line"), F.lit("v1").alias("version"), (F.col("quality") * 0.8).alias("reach"), (F.col("toxic") * 0.7).alias("surprise"), F.lit(None).cast("double").alias("directive"), F.lit(0.1).alias("sensitivity"))


def rating_left_join_defaults(spark, d):
    return rated(_observations(spark, d), _ratings(spark, d)).select("id", "reach", "surprise", "directive", "sensitivity")


def unrated_anti(spark, d):
    return stale_ratings(_observations(spark, d), _ratings(spark, d), "v1").select("id")


def calibration_sample(spark, d):
    rated = _entries(spark, d).select(F.col("event_id").alias("id"), (F.col("value") / 100.0).alias("reach"), (F.col("k") / 100.0).alias("directive"))
    return reports.calibration_sample(rated)


def cost_by_phase(spark, d):
    usage = {"input": F.col("k") * 100.0, "cached": F.col("k") * 20.0, "output": F.col("value")}
    prices = {"input": F.lit(1.25), "cached": F.lit(0.125), "output": F.lit(10.0)}
    factor = s.tier_factor(F.when(F.col("k") % 2 == 0, "flex").otherwise("default"), F.when(F.col("k") % 3 == 0, "flex").otherwise("default"))
    calls = _entries(spark, d).select(F.col("event_type").alias("phase"), F.col("kind").alias("model"), factor.cast("string").alias("tier"), s.call_cost(prices, usage, factor).alias("cost"))
    return reports.cost_by(calls).select("phase", "model", "tier", "calls", F.round("cost", 6).alias("cost"))


def table_counts(spark, d):
    return reports.table_counts({n: table(spark, d, n) for n in ("events", "documents", "labels", "conversations", "embeddings", "pages")})


def present_time(spark, d):
    """The latest source's time, no later than now; every fourth entry tells another date."""
    told = F.when(F.col("k") % 4 == 0, F.date_format("ts", "yyyy-MM-dd"))
    dated = _entries(spark, d).select(told.alias("happened"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created"))
    return dated.agg(reports.present("happened", "created", F.lit(NOW).cast("timestamp")).alias("t")).select(F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("present"))


def page_inbound(spark, d):
    """Orders as observations on the pages of their parts: how many other pages each shares one with."""
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("page"))
    return reports.page_inbound(links)


def browse_page(spark, d):
    """One page of a listing: what was asked for, and whether there is more."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return reports.page_of(orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], limit=40, offset=80)


QUERIES = {
    f.__name__: f
    for f in (
        freshness_decay, source_kind_case, standing_score, situational_score, chunk_score, page_score, source_prior_max,
        rating_left_join_defaults, unrated_anti, calibration_sample, cost_by_phase, table_counts, present_time, page_inbound, browse_page,
    )
}

_KINDS = "[" + ", ".join(f"'{k}'" for k in s.SOURCE_PRIORS) + "]"
_PRIOR = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in s.SOURCE_PRIORS.items()) + " ELSE 0::DOUBLE END"
_ENTRIES = f"""raw AS (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events),
entries AS (SELECT *, CASE WHEN event_type IN ('purchase', 'view') THEN {_KINDS}[k % 7 + 1] WHEN event_type = 'click' THEN 'note_user' ELSE 'note_agent' END AS kind FROM raw),
vars AS (
  SELECT *, {_PRIOR} AS source_prior, least(value / 200.0::DOUBLE, 1.0::DOUBLE) AS reach, CASE WHEN k % 3 <> 0 THEN k / 100.0::DOUBLE ELSE 0.5::DOUBLE END AS surprise,
         (k % 5) / 10.0::DOUBLE AS directive, CASE WHEN k % 4 <> 0 THEN 0.5::DOUBLE + k / 200.0::DOUBLE ELSE 0.9::DOUBLE END AS confidence,
         pow(2::DOUBLE, -greatest(0::DOUBLE, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 86400e6::DOUBLE) / 14::DOUBLE) AS freshness,
         1.0::DOUBLE + k % 6 AS sources, k / 97.0::DOUBLE AS relevance
  FROM entries
)"""
_STANDING = "greatest(0::DOUBLE, reach * (.35::DOUBLE + .65::DOUBLE * surprise) * (1 + directive * reach) * (.5::DOUBLE + .5::DOUBLE * confidence) * freshness * (.6::DOUBLE + .4::DOUBLE * source_prior) * (1 + .15::DOUBLE * ln(1 + sources))) * 1.15::DOUBLE"
_RATINGS = """obs AS (SELECT doc_id AS id, md5(text) AS line FROM documents),
ratings AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'an older line' ELSE line END AS line, quality * 0.8::DOUBLE AS reach, toxic * 0.7::DOUBLE AS surprise FROM labels JOIN obs ON id = doc_id)"""

ORACLE_SQL = {
    "freshness_decay": f"""WITH {_ENTRIES} SELECT event_id, round(CASE WHEN event_type <> 'error' THEN
  pow(2::DOUBLE, -greatest(0::DOUBLE, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 86400e6::DOUBLE) / (1.0::DOUBLE + k % 9)) ELSE 1 END, 6) AS freshness FROM entries""",
    "source_kind_case": f"WITH {_ENTRIES} SELECT event_id, kind, source_prior AS prior FROM vars",
    "standing_score": f"WITH {_ENTRIES}, scored AS (SELECT event_id, {_STANDING} AS x FROM vars) SELECT event_id, round(x, 6) AS score, CASE WHEN x >= 0.6 THEN 3 WHEN x >= 0.3 THEN 2 ELSE 1 END AS bucket FROM scored",
    "situational_score": f"WITH {_ENTRIES} SELECT event_id, round(greatest(0::DOUBLE, relevance * 1.05::DOUBLE * (.75::DOUBLE + .25::DOUBLE * reach) * (.5::DOUBLE + .5::DOUBLE * confidence) * (.7::DOUBLE + .3::DOUBLE * freshness) * source_prior), 6) AS score FROM vars",
    "chunk_score": f"WITH {_ENTRIES} SELECT event_id, round(greatest(0::DOUBLE, relevance * (.5::DOUBLE + .5::DOUBLE * max(reach) OVER (PARTITION BY user_id)) * source_prior), 6) AS score FROM vars",
    "page_score": f"WITH {_ENTRIES}, per AS (SELECT user_id, max(reach) AS best, count(*) AS n, count(DISTINCT kind) AS kinds FROM vars GROUP BY user_id) SELECT user_id, round(greatest(0::DOUBLE, best * (1 + .1::DOUBLE * ln(1 + n) + .05::DOUBLE * ln(1 + kinds))), 6) AS score FROM per",
    "source_prior_max": f"WITH {_ENTRIES} SELECT user_id, max(source_prior) AS prior, count(*) AS sources FROM vars GROUP BY user_id",
    "rating_left_join_defaults": f"WITH {_RATINGS} SELECT id, coalesce(reach, 0.5::DOUBLE) AS reach, coalesce(surprise, 0.5::DOUBLE) AS surprise, 0.0::DOUBLE AS directive, CASE WHEN reach IS NULL THEN 0.0::DOUBLE ELSE 0.1::DOUBLE END AS sensitivity FROM obs LEFT JOIN ratings USING (id, line)",
    "unrated_anti": f"WITH {_RATINGS} SELECT id FROM obs ANTI JOIN ratings USING (id, line)",
    "calibration_sample": f"""WITH {_ENTRIES}, r AS (SELECT event_id AS id, value / 100.0::DOUBLE AS reach, k / 100.0::DOUBLE AS directive FROM entries),
banded AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN reach >= 0.7 THEN 2 WHEN reach >= 0.4 THEN 1 ELSE 0 END ORDER BY id DESC) AS n FROM r)
SELECT id, reach, directive FROM banded WHERE n <= 3 UNION SELECT * FROM (SELECT id, reach, directive FROM r WHERE directive >= 0.6 ORDER BY id DESC LIMIT 2)""",
    "cost_by_phase": f"""WITH {_ENTRIES}, calls AS (SELECT *, CASE WHEN k % 2 = 0 AND k % 3 <> 0 THEN 2.0::DOUBLE WHEN k % 2 <> 0 AND k % 3 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS f FROM entries)
SELECT event_type AS phase, kind AS model, CAST(f AS VARCHAR) AS tier, count(*) AS calls, round(sum(f * ((k * 100.0 - k * 20.0) * 1.25 + k * 20.0 * 0.125 + value * 10.0) / 1e6), 6) AS cost FROM calls GROUP BY ALL""",
    "table_counts": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n_rows FROM {n}" for n in ("events", "documents", "labels", "conversations", "embeddings", "pages")),
    "present_time": f"""WITH {_ENTRIES}, m AS (SELECT max(CASE WHEN k % 4 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END) AS t FROM entries)
SELECT strftime(least(CAST(replace(replace(t, 'T', ' '), 'Z', '') AS TIMESTAMP), TIMESTAMP '{NOW}'), '%Y-%m-%d %H:%M:%S') AS present FROM m""",
    "page_inbound": """WITH links AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS page FROM lineitem), pairs AS (SELECT DISTINCT a.page, b.page AS other FROM links a JOIN links b ON a.id = b.id AND a.page <> b.page),
n AS (SELECT page, count(*) AS observations FROM links GROUP BY page)
SELECT n.page, observations, count(other) AS inbound FROM n LEFT JOIN pairs ON pairs.page = n.page GROUP BY n.page, observations""",
    "browse_page": """WITH paged AS (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 41 OFFSET 80)
SELECT *, (SELECT count(*) FROM paged) > 40 AS more FROM (SELECT * FROM paged ORDER BY o_totalprice DESC, o_orderkey LIMIT 40)""",
}
