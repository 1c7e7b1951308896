"""op6_line_dedup over all documents."""

from pyspark.sql import functions as F

from recollect.llm.line_dedup import without_repeated_lines
from recollect.llm.shared import table


def op6_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = without_repeated_lines(docs)
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op6_line_dedup": op6_line_dedup}

ORACLE_SQL = {
    "op6_line_dedup": r"""
WITH keyed AS (
  SELECT doc_id, lines, list_transform(lines, lambda x: translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS keys
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
), repeated AS (
  SELECT key, max(doc_id) AS last
  FROM (SELECT DISTINCT doc_id, unnest(keys) AS key FROM keyed)
  WHERE length(key) >= 40
  GROUP BY key
  HAVING count(*) >= 5
), drops AS (
  SELECT doc_id, list(DISTINCT key) AS gone
  FROM (SELECT doc_id, unnest(keys) AS key FROM keyed) JOIN repeated USING (key)
  WHERE doc_id <> last
  GROUP BY doc_id
), kept AS (
  SELECT doc_id, lines, list_filter(list_zip(lines, keys), lambda x: NOT list_contains(coalesce(gone, []), x[2])) AS rest
  FROM keyed LEFT JOIN drops USING (doc_id)
)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(rest) AS BIGINT) AS n_dropped,
       sha256(array_to_string(list_transform(rest, lambda x: x[1]), chr(10))) AS kept_sha256
FROM kept
"""
}
