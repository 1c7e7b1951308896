"""op4_url_filter over all pages."""

from recollect.llm.shared import table
from recollect.llm.url_filter import NO_PROSE, NO_TEXT, SPAM_WORDS, Rule, default_globs, judge_urls

RULES = [
    Rule("allow", "org"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]


def op4_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, RULES, block_globs=default_globs()).select("page_id", "host", "path", "rule", "verdict")


_BLOCKED = "|".join([f"^([^/]*[.-])?({'|'.join(SPAM_WORDS)})[.-]", f"/(?s:.*)\\.({'|'.join(NO_TEXT)})$", *NO_PROSE])

QUERIES = {"op4_url_filter": op4_url_filter}

ORACLE_SQL = {
    "op4_url_filter": rf"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(verdict, h, p) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), best AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches(host || path, '{_BLOCKED}') THEN 'block' ELSE 'allow' END) AS verdict
FROM split LEFT JOIN best USING (page_id)
"""
}
