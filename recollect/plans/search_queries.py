"""Queries of the retrievers. Every row whose id is divisible by 20 asks, all rows may be found."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect.operators import retrieval as r
from recollect.plans.common import table

K, MATCHES = 10, 5


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _vector_queries(spark, d):
    return _vectors(spark, d).where("id % 20 = 0").withColumnRenamed("id", "query_id")


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _text_queries(spark, d):
    return table(spark, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")


def cosine_topk(spark, d):
    found = r.nearest(_vector_queries(spark, d), _vectors(spark, d), K)
    return found.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


def scoped_topk(spark, d):
    """Hits of the query's own label only."""
    found = r.nearest(_vector_queries(spark, d), _vectors(spark, d), K, scope=["label"])
    return found.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


def bm25_topk(spark, d):
    found = r.bm25(_text_queries(spark, d), _docs(spark, d), r.CANDIDATES)
    return found.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


def phrase_match(spark, d):
    """Documents that hold a whole benchmark passage, word for word."""
    passages = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return r.phrase_hits(passages, _docs(spark, d))


def rrf_search(spark, d):
    """Vectors and texts share their ids; a query is a vector and a benchmark passage of the same id."""
    found = r.search(_vector_queries(spark, d), _text_queries(spark, d), _vectors(spark, d), _docs(spark, d))
    return found.select("query_id", "id", "rank", F.round("relevance", 6).alias("relevance"))


def named_page_bonus(spark, d):
    """Every part's name is looked for in all conversations."""
    names = table(spark, d, "part").select(F.col("p_name").alias("page"), F.col("p_name").alias("name")).distinct()
    words = table(spark, d, "nation").select(F.concat(F.lit("the"), F.col("n_nationkey").cast("string")).alias("page"), F.element_at(F.array(*map(F.lit, ("the", "queue", "der", "is", "una"))), F.col("n_regionkey") + 1).alias("name"))
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    return r.named_pages(turns, names.union(words))


def candidate_matches(spark, d):
    """The five best existing vectors for each candidate, fused over two facets: all labels, its own label."""
    asked = _vector_queries(spark, d)
    both = r.nearest(asked, _vectors(spark, d)).select("query_id", "id", "rank").union(r.nearest(asked, _vectors(spark, d), scope=["label"]).select("query_id", "id", "rank"))
    fused = r.fused(both.where("query_id != id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf", 12)), "id"))
    return fused.withColumn("rank", rank).where(F.col("rank") <= MATCHES).select("query_id", "id", "rank", F.round("rrf", 6).alias("rrf"))


QUERIES = {f.__name__: f for f in (cosine_topk, scoped_topk, bm25_topk, phrase_match, rrf_search, named_page_bonus, candidate_matches)}

_COSINE = """pairs AS MATERIALIZED (
  SELECT q.vec_id AS query_id, v.vec_id AS id, q.label = v.label AS same, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score
  FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0
)"""
_TERMS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_BM25 = f"""tokens AS MATERIALIZED (SELECT doc_id AS id, {_TERMS} AS t FROM documents),
stats AS (SELECT count(*) AS n, avg(len(t)) AS size FROM tokens),
asked AS MATERIALIZED (SELECT item_id AS query_id, unnest(list_distinct({_TERMS})) AS term FROM benchmark WHERE item_id % 20 = 0),
held AS MATERIALIZED (SELECT id, size, term, count(*) AS tf FROM (SELECT id, len(t) AS size, unnest(t) AS term FROM tokens) WHERE term IN (SELECT term FROM asked) GROUP BY id, size, term),
weight AS (SELECT term, CASE WHEN ln((n - count(*) + 0.5) / (count(*) + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - count(*) + 0.5) / (count(*) + 0.5)) END AS idf FROM held, stats GROUP BY term, n),
scored AS (
  SELECT query_id, held.id, sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * held.size / stats.size))) AS score
  FROM asked JOIN weight USING (term) JOIN held USING (term), stats GROUP BY query_id, held.id
), lexical AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank FROM scored)"""

ORACLE_SQL = {
    "cosine_topk": f"""WITH {_COSINE}, ranked AS (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, round(score, 6) AS score FROM pairs)
SELECT * FROM ranked WHERE rank <= {K}""",
    "scoped_topk": f"""WITH {_COSINE}, ranked AS (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, round(score, 6) AS score FROM pairs WHERE same)
SELECT * FROM ranked WHERE rank <= {K}""",
    "bm25_topk": f"WITH {_BM25} SELECT query_id, id, rank, round(score, 6) AS score FROM lexical WHERE rank <= 100",
    "phrase_match": f"""WITH d AS (SELECT doc_id, ' ' || array_to_string({_TERMS}, ' ') || ' ' AS body FROM documents), p AS (SELECT item_id, ' ' || array_to_string({_TERMS}, ' ') || ' ' AS phrase FROM benchmark)
SELECT item_id AS query_id, doc_id AS id FROM p JOIN d ON contains(body, phrase)""",
    "rrf_search": f"""WITH {_COSINE}, {_BM25}, vector AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM pairs),
fused AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM (SELECT query_id, id, rank FROM vector WHERE rank <= 100 UNION ALL SELECT query_id, id, rank FROM lexical WHERE rank <= 100) GROUP BY query_id, id),
rel AS (SELECT query_id, id, rrf / max(rrf) OVER (PARTITION BY query_id) AS relevance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, id) AS INTEGER) AS rank FROM fused)
SELECT query_id, id, rank, round(relevance, 6) AS relevance FROM rel WHERE rank <= 40""",
    "named_page_bonus": f"""WITH names AS (SELECT DISTINCT p_name AS page, p_name AS text FROM part UNION ALL SELECT 'the' || n_nationkey, ['the', 'queue', 'der', 'is', 'una'][n_regionkey + 1] FROM nation),
n AS (SELECT page, array_to_string({_TERMS}, ' ') AS name FROM names), q AS (SELECT conv_id * 1000 + turn AS query_id, ' ' || array_to_string({_TERMS}, ' ') || ' ' AS body FROM conversations)
SELECT DISTINCT query_id, page FROM q JOIN n ON strlen(name) >= 3 AND contains(body, ' ' || name || ' ')""",
    "candidate_matches": f"""WITH {_COSINE}, a AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM pairs),
b AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM pairs WHERE same),
fused AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM (SELECT * FROM a WHERE rank <= 100 UNION ALL SELECT * FROM b WHERE rank <= 100) WHERE query_id <> id GROUP BY query_id, id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, id) AS INTEGER) AS rank FROM fused)
SELECT query_id, id, rank, round(rrf, 6) AS rrf FROM ranked WHERE rank <= {MATCHES}""",
}
