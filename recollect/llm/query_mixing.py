"""op5_source_mix over all documents."""

from pyspark.sql import functions as F

from recollect.llm.mixing import mixed
from recollect.llm.shared import table


def op5_source_mix(spark, sf_dir):
    mix = mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


QUERIES = {"op5_source_mix": op5_source_mix}

ORACLE_SQL = {
    "op5_source_mix": r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST(concat('0x', substr(md5('mix-1:' || doc_id), 1, 8)) AS BIGINT) AS hash
  FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source
), weighted AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS cap,
         CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM totals
), summed AS (
  SELECT *, sum(cap) OVER w - cap AS before, sum(weight) OVER r AS open, sum(source_size) OVER () * 1.5::DOUBLE AS budget
  FROM weighted
  WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         r AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), level AS (
  SELECT arg_min((budget - before) / open, before) AS level FROM summed WHERE (budget - before) / open * weight <= cap
), plan AS (
  SELECT source, source_size, coalesce(least(cap, level * weight), cap) AS target FROM summed, level
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM plan
), ordered AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS goal,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sizes s JOIN rated p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN goal > 0 AND 2 * goal >= 2 * upto - size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ordered
"""
}
