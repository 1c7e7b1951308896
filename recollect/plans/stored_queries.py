"""Queries of stored postings, streams with keyed state, dependencies of entries, and what folders hide."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from recollect.functions.text import terms
from recollect.operators import briefs, fold
from recollect.operators.postings import Postings, name_hits
from recollect.operators.retrieval import CANDIDATES
from recollect.operators.tables import shared_folder
from recollect.plans.common import table
from recollect.plans.memory_queries import _MESSAGES, _messages
from recollect.plans.search_queries import _TERMS, _docs, _text_queries
from recollect.plans.search_queries import ORACLE_SQL as _SEARCH
from recollect.streaming import cursors


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/recollect-{uuid.uuid4().hex[:12]}"


def _index(spark, d) -> Postings:
    """Documents indexed in two steps; of every third an older text that the second step takes out."""
    docs = _docs(spark, d)
    index = Postings(spark, _folder(spark))
    older = docs.where("id % 3 = 0").select((-1 - F.col("id")).alias("id"), F.left("text", F.lit(500)).alias("text"))
    index.extend(docs.where("id % 3 != 0").union(older))
    index.extend(docs.where("id % 3 = 0"), older.select("id"))
    return index


def stored_bm25(spark, d):
    return _index(spark, d).bm25(_text_queries(spark, d), CANDIDATES).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


def stored_phrases(spark, d):
    """Documents that hold a whole benchmark passage, word for word, by positions."""
    return _index(spark, d).phrase_hits(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


def candidate_names(spark, d):
    """Benchmark items as candidates, named by the first words of the next item and of their own; chosen are all documents that begin alike."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("candidate"), F.array_join(F.slice(terms(F.col("text")), 1, 3), " ").alias("name"))
    names = items.select((F.col("candidate") - 1).alias("candidate"), F.lit(0).alias("at"), "name").union(items.select("candidate", F.lit(1).alias("at"), "name"))
    heads = _docs(spark, d).select("id", F.array_join(F.slice(terms(F.col("text")), 1, 3), " ").alias("name"))
    chosen = names.join(heads, "name").select("candidate", "id")
    return name_hits(_index(spark, d), names, chosen)


def prefix_cursor_stream(spark, d):
    """Documents as files, read as they grow: half of each, then all of it, rewritten where quality is 0, then all again."""
    folder = _folder(spark)
    half = F.left("text", F.floor(F.length("text") / 2).cast("int"))
    docs = table(spark, d, "documents").where("text is not null").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    docs = docs.select(F.col("doc_id").cast("string").alias("path"), "text", half.alias("head"), F.coalesce(F.col("quality") == 0, F.lit(False)).alias("changed"))
    stream = spark.readStream.schema("path string, activity timestamp, content binary").parquet(f"{folder}/in/*")
    whole = F.when(F.col("changed"), F.concat(F.lit("x"), "text")).otherwise(F.col("text"))
    for day, content in enumerate((F.col("head"), whole, whole), 1):
        docs.select("path", F.lit(f"2024-01-0{day}").cast("timestamp").alias("activity"), F.encode(content, "UTF-8").alias("content")).write.option("compression", "zstd").parquet(f"{folder}/in/{day}")
        with cursors.state_store(spark, spark.sparkContext.defaultParallelism):
            told = cursors.increments(stream).withColumn("run", F.lit(day))
            query = told.writeStream.format("parquet").option("compression", "zstd").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cursor").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(F.col("path").cast("long").alias("doc_id"), "run", "status", "length", F.md5("text").alias("text_md5"))


def new_message_stream(spark, d):
    """Messages of all users, streamed in two parts that overlap, each once and not before the user has spoken."""
    folder = _folder(spark)
    messages = _messages(spark, d).select(F.col("session").cast("string").alias("session"), F.col("id").cast("string").alias("id"), "role", F.col("timestamp").cast("string").alias("timestamp"), F.lit("").alias("text"), "k")
    stream = spark.readStream.schema(cursors.MESSAGE).parquet(f"{folder}/in/*")
    for run, part in enumerate((F.col("k") < 60, F.col("k") >= 40)):
        messages.where(part).drop("k").write.parquet(f"{folder}/in/{run}")
        with cursors.state_store(spark, spark.sparkContext.defaultParallelism):
            told = cursors.new_messages(stream).withColumn("run", F.lit(run))
            query = told.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/seen").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(F.col("session").cast("long").alias("session"), F.col("id").cast("long").alias("id"), "role", "run")


def dependency_order(spark, d):
    """Events as entries, views being sources; of the others some name an event three on, or two before."""
    events = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", "source").otherwise("note").alias("kind"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    ref = F.when(F.col("k") % 4 == 0, F.col("seq") + 3).when(F.col("k") % 4 == 1, F.col("seq") - 2)
    refs = events.where("kind = 'note'").select("seq", ref.alias("ref")).where("ref is not null")
    return fold.dependency_order(events.select("seq", "kind"), refs, events.select("seq", F.col("seq").alias("id")), events.where("false").select(F.col("seq").alias("id")))


def hidden_rows(spark, d):
    """Suppliers below their nations, of which a folder hides some of either."""
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("page"))
    nations = table(spark, d, "nation").where("n_regionkey = 1").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("id"))
    hidden = nations.union(suppliers.where("cast(id as int) % 10 = 3").select("id"))
    return fold.without_hidden(suppliers.select("id"), suppliers.select("id", "page"), hidden).select(F.col("id").cast("long").alias("id"))


def page_order(spark, d):
    """Parts as ranked lines on the pages of their brand and their container, in a brief's order."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 10000).cast("double").alias("rank"), "p_brand", "p_type")
    links = parts.select("id", F.col("p_brand").alias("page")).union(parts.select("id", F.col("p_type").alias("page")))
    found = briefs.page_order(parts.select("id", "rank"), links, links.select("page").distinct())
    return found.select("page", F.round("best", 6).alias("best"), "observations", "inbound", F.round("score", 6).alias("score"), "order")


QUERIES = {f.__name__: f for f in (stored_bm25, stored_phrases, candidate_names, prefix_cursor_stream, new_message_stream, dependency_order, hidden_rows, page_order)}

_HALF = "substr(text, 1, CAST(floor(length(text) / 2) AS INTEGER))"

ORACLE_SQL = {
    "stored_bm25": _SEARCH["bm25_topk"],
    "stored_phrases": _SEARCH["phrase_match"],
    "candidate_names": f"""WITH d AS MATERIALIZED (SELECT doc_id AS id, {_TERMS} AS t FROM documents),
bodies AS MATERIALIZED (SELECT id, t, ' ' || array_to_string(t, ' ') || ' ' AS body FROM d),
items AS (SELECT item_id, {_TERMS}[1:3] AS p FROM benchmark),
names AS (SELECT item_id - 1 AS candidate, 0 AS place, p FROM items UNION ALL SELECT item_id, 1, p FROM items),
met AS (SELECT p, id, len(t) AS size, len(list_filter(range(1, len(t) + 1), lambda i: t[i:i + len(p) - 1] = p)) AS tf FROM (SELECT DISTINCT p FROM items) JOIN bodies ON contains(body, ' ' || array_to_string(p, ' ') || ' ')),
stats AS (SELECT count(*) AS n, avg(len(t)) AS average FROM d),
weighed AS (SELECT *, count(*) OVER (PARTITION BY p) AS df FROM met),
best AS (
  SELECT p, arg_min(id, (-round(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / average)), 9), id)) AS id
  FROM weighed, stats GROUP BY p
)
SELECT candidate, CAST(min(place) AS INTEGER) AS "at", arg_min(best.id, place) AS id FROM names JOIN best USING (p)
WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.id = best.id AND d.t[1:3] = names.p OR d.id = best.id AND d.t[1:3] IN (SELECT p FROM names o WHERE o.candidate = names.candidate)) GROUP BY candidate""",
    "prefix_cursor_stream": f"""WITH docs AS (SELECT doc_id, text, {_HALF} AS head, CASE WHEN coalesce(quality = 0, false) THEN 'x' || text ELSE text END AS whole FROM documents LEFT JOIN labels USING (doc_id) WHERE text IS NOT NULL),
told AS (
  SELECT doc_id, 1 AS run, 'new' AS status, head AS content, head AS text FROM docs
  UNION ALL
  SELECT doc_id, run, CASE WHEN NOT starts_with(whole, head) THEN 'rewritten' WHEN run = 3 OR whole = head THEN 'unchanged' ELSE 'appended' END, whole,
    CASE WHEN run = 2 AND starts_with(whole, head) AND whole <> head THEN substr(whole, length(head) + 1) END
  FROM docs, (SELECT unnest([2, 3]) AS run)
)
SELECT doc_id, CAST(run AS INTEGER) AS run, status, CAST(strlen(content) AS BIGINT) AS length, md5(text) AS text_md5 FROM told""",
    "new_message_stream": f"""WITH {_MESSAGES}, spoken AS (SELECT session, CASE WHEN min(CASE WHEN role = 'user' THEN CASE WHEN k < 60 THEN 0 ELSE 1 END END) = 0 THEN 0 ELSE 1 END AS first_run, max(CASE WHEN role = 'user' AND k >= 60 THEN 1 ELSE 0 END) AS again, max(CASE WHEN role = 'user' AND k < 60 THEN 1 ELSE 0 END) AS soon FROM m GROUP BY session)
SELECT session, id, role, CAST(CASE WHEN k < 60 AND first_run = 0 THEN 0 ELSE 1 END AS INTEGER) AS run FROM m JOIN spoken USING (session) WHERE k < 60 AND soon = 1 OR again = 1""",
    "dependency_order": """WITH RECURSIVE e AS (SELECT event_id AS seq, CASE WHEN event_type = 'view' THEN 'source' ELSE 'note' END AS kind, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events),
s AS (SELECT seq, row_number() OVER (ORDER BY seq) AS phase FROM e WHERE kind = 'source'),
r AS (SELECT seq, CASE k % 4 WHEN 0 THEN seq + 3 WHEN 1 THEN seq - 2 END AS ref FROM e WHERE kind = 'note'),
placed(seq, phase, turn) AS (
  (SELECT seq, phase, 0 FROM s UNION ALL SELECT seq, 0, 1 FROM r WHERE ref IS NULL)
  UNION ALL
  SELECT r.seq, phase, turn + 1 FROM placed JOIN r ON ref = placed.seq
)
SELECT seq, kind, CAST(phase AS BIGINT) AS phase, CAST(turn AS INTEGER) AS turn FROM e LEFT JOIN placed USING (seq)""",
    "hidden_rows": "SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 10 <> 3 AND s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "page_order": """WITH links AS (SELECT p_partkey AS id, p_brand AS page, CAST(p_retailprice / 10000 AS DOUBLE) AS rank FROM part UNION ALL SELECT p_partkey, p_type, CAST(p_retailprice / 10000 AS DOUBLE) FROM part),
stats AS (SELECT page, max(rank) AS best, count(*) AS observations FROM links GROUP BY page),
beside AS (SELECT x.page, count(DISTINCT y.page) AS inbound FROM links x JOIN links y ON x.id = y.id AND x.page <> y.page GROUP BY x.page),
scored AS (SELECT page, best, observations, coalesce(inbound, 0) AS inbound, greatest(0::DOUBLE, best * (1 + .1::DOUBLE * ln(1 + observations) + .05::DOUBLE * ln(1 + coalesce(inbound, 0)))) AS score FROM stats LEFT JOIN beside USING (page))
SELECT page, round(best, 6) AS best, observations, inbound, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, page) AS "order" FROM scored""",
}
