"""op2_minhash_dedup over all documents."""

from recollect.llm.minhash_dedup import near_duplicates
from recollect.llm.shared import table


def op2_minhash_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op2_minhash_dedup": op2_minhash_dedup}

ORACLE_SQL = {
    "op2_minhash_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
                      WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words
), shingles AS MATERIALIZED (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), reach(id, seen) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.seen
)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(seen) AS component_id, sets.doc_id = min(seen) AS kept
FROM sets JOIN reach ON reach.id = sets.doc_id
GROUP BY sets.doc_id, s
"""
}
