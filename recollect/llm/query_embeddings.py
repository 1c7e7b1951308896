"""op3_embedding_dedup over all embeddings."""

from recollect.llm.embedding_dedup import near_duplicate_vectors
from recollect.llm.shared import table


def op3_embedding_dedup(spark, sf_dir):
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op3_embedding_dedup": op3_embedding_dedup}

ORACLE_SQL = {
    "op3_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.95
), reach(id, seen) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.seen
), parts AS (
  SELECT id, min(seen) AS component_id FROM reach GROUP BY id
), counts AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN parts ON id = vec_id LEFT JOIN counts ON a = vec_id
"""
}
