"""op12_repeated_passages over all documents."""

from recollect.llm.repeated_passages import without_repeats
from recollect.llm.shared import table


def op12_repeated_passages(spark, sf_dir):
    return without_repeats(table(spark, sf_dir, "documents")).drop("span_starts", "span_lengths")


QUERIES = {"op12_repeated_passages": op12_repeated_passages}

# Two hex digits are a byte; text of ASCII makes substr fast.
ORACLE_SQL = {
    "op12_repeated_passages": """
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), strings AS MATERIALIZED (
  SELECT r, i, substr(x, 2 * i + 1, 400) AS s FROM (SELECT r, x, unnest(range(0, len(x) // 2 - 199)) AS i FROM texts)
), twice AS (
  SELECT s FROM strings GROUP BY s HAVING count(*) > 1
), hits AS (
  SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM strings SEMI JOIN twice USING (s)
), numbered AS (
  SELECT r, i, sum(CASE WHEN i <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS span FROM hits
), spans AS (
  SELECT r, span, min(i) AS low, max(i) + 200 AS high FROM numbered GROUP BY r, span
), cuts AS (
  SELECT r, low, high, coalesce(lag(high) OVER (PARTITION BY r ORDER BY low), 0) AS since FROM spans
), removed AS (
  SELECT r, count(*) AS n_spans, sum(high - low) AS n_removed, string_agg(substr(x, 2 * since + 1, 2 * (low - since)), '' ORDER BY low) AS head, max(high) AS last
  FROM cuts JOIN texts USING (r) GROUP BY r
)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM texts LEFT JOIN removed USING (r)
"""
}
