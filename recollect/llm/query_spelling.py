"""op13_spelling_variants over all documents."""

from recollect.llm.shared import table
from recollect.llm.spelling_variants import spelling_variants


def op13_spelling_variants(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {"op13_spelling_variants": op13_spelling_variants}

# CRC-32 by its table of 256 remainders, made from the polynomial.
ORACLE_SQL = {
    "op13_spelling_variants": r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS rest
), found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), runs AS (
  SELECT run, count(*) AS k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM found GROUP BY doc_id, run
), hashed AS (
  SELECT run, k, xor(list_reduce(list_transform(range(1, len(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT)), lambda c, b: xor(rest[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) AS h
  FROM runs, crc
), words AS MATERIALIZED (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % len(run) AS INT)) || substr(run, CAST(h % len(run) AS INT) + 2) ELSE run END AS word, CAST(sum(k) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING len(word) >= 6 AND sum(k) >= 5
), places AS MATERIALIZED (
  SELECT word, unnest(range(1, len(word) + 1)) AS i FROM words
), cut AS MATERIALIZED (
  SELECT word, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM places
), pairs AS (
  SELECT x.word AS word, y.word AS near FROM cut x JOIN cut y ON x.i = y.i AND x.head = y.head AND x.tail = y.tail AND x.word <> y.word
  UNION
  SELECT cut.word, words.word FROM cut JOIN words ON words.word = head || tail
  UNION
  SELECT words.word, cut.word FROM cut JOIN words ON words.word = head || tail
), best AS (
  SELECT pairs.word, count(*) AS n_near, arg_min(near, (-w.n, near)) AS near, max(w.n) AS near_n
  FROM pairs JOIN words w ON w.word = near GROUP BY pairs.word
), forms AS MATERIALIZED (
  SELECT word, CASE WHEN near_n >= 5 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), ends(word, root) AS (
  SELECT word, word FROM forms
  UNION ALL
  SELECT ends.word, form FROM ends JOIN forms ON forms.word = root WHERE form IS NOT NULL
), roots AS (
  SELECT ends.word, root FROM ends JOIN forms ON forms.word = root WHERE form IS NULL
)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM forms JOIN roots USING (word)
"""
}
