"""Queries over texts, conversations and URLs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect.functions import text as t
from recollect.functions.names import glob_match
from recollect.operators.budget import first_fit, windows
from recollect.operators.validation import field_problem
from recollect.plans.common import table
from recollect.sources.log import dedup_key
from recollect.sources.routing import longest_prefix

CHUNK_LINES, WINDOW_TOKENS, BUDGET, CUT = 3, 120, 60, 200


def doc_token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", t.token_estimate(F.col("text")).alias("tokens"))


def doc_normalized_terms(spark, d):
    norm = t.normalized(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t.terms(F.col("text"))).cast("long").alias("n_terms"), F.md5(norm).alias("normalized_md5"))


def doc_vocab_df(spark, d):
    each = table(spark, d, "documents").select(F.explode(F.array_distinct(t.terms(F.col("text")))).alias("term"))
    return each.groupBy("term").agg(F.count("*").alias("df"))


def _chunks(spark, d):
    """Chunks of a few lines; a chunk ends before the next begins, the last with the text."""
    lines = table(spark, d, "documents").select("doc_id", "text", F.size(F.split("text", "\n")).alias("n"))
    starts = lines.select("*", F.explode(F.expr(f"sequence(1, n, {CHUNK_LINES})")).alias("start_line"))
    per = Window.partitionBy("doc_id").orderBy("start_line")
    ends = F.coalesce(F.lead("start_line").over(per) - 1, F.col("n"))
    numbered = starts.select("doc_id", (F.row_number().over(per) - 1).alias("chunk"), "start_line", ends.alias("end_line"), "text")
    return numbered.withColumn("text", t.line_slice(F.col("text"), F.col("start_line"), F.col("end_line")))


def line_chunks(spark, d):
    return _chunks(spark, d).select("doc_id", "chunk", "start_line", "end_line", F.md5("text").alias("text_md5"))


def chunk_neighbors(spark, d):
    per = Window.partitionBy("doc_id").orderBy("chunk")
    ids = _chunks(spark, d).select("doc_id", "chunk", F.concat(F.lit("src:"), F.col("doc_id").cast("string"), F.lit("/"), F.col("chunk").cast("string")).alias("chunk_id"))
    return ids.select("chunk_id", F.lag("chunk_id").over(per).alias("previous"), F.lead("chunk_id").over(per).alias("next"))


def greedy_windows(spark, d):
    sized = _chunks(spark, d).select("doc_id", "chunk", t.token_estimate(F.col("text")).alias("tokens"))
    return windows(sized, ["doc_id"], [F.col("chunk")], "tokens", WINDOW_TOKENS).select("doc_id", "chunk", "tokens", "window")


def firstfit_budget(spark, d):
    sized = table(spark, d, "conversations").select("conv_id", "turn", t.token_estimate(F.col("text")).alias("tokens"))
    return first_fit(sized, ["conv_id"], [F.col("turn")], "tokens", BUDGET).select("conv_id", "turn", "tokens", "used")


def content_dedup(spark, d):
    keyed = table(spark, d, "documents").select(dedup_key(F.lit("document"), F.col("text")).alias("hash"), "doc_id")
    return keyed.groupBy("hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


def conflict_groups(spark, d):
    keyed = table(spark, d, "documents").select(dedup_key(F.lit("document"), F.col("text")).alias("hash"), F.struct("lang", "source").alias("payload"))
    return keyed.groupBy("hash").agg(F.countDistinct("payload").alias("payloads")).where("payloads > 1")


def _paths(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    return pages.withColumn("path", F.regexp_extract("url", r"^[^:]+://([^?#]*)", 1))


def exclude_glob(spark, d):
    return _paths(spark, d).select("page_id", glob_match(F.col("path"), "**/fr/*").alias("french"), glob_match(F.col("path"), "*/en/?*").alias("english"))


ROUTES = (("blog.", "blog"), ("m.", "mobile"), ("", "web"), ("m.th", "mobile-th"))


def longest_prefix_route(spark, d):
    routes = spark.createDataFrame(list(ROUTES), "root string, home string")
    return longest_prefix(_paths(spark, d), "path", routes).select("page_id", "home")


def home_slug(spark, d):
    return _paths(spark, d).select("page_id", t.home_slug(F.col("path")).alias("slug"))


def _dialogue(spark, d):
    return table(spark, d, "conversations").where(F.col("role").isin("user", "assistant"))


def transcript_render(spark, d):
    """A transcript for each conversation with a user's message."""
    turn = t.rendered_turn(F.lit(None).cast("string"), F.col("role"), t.cleaned(F.col("text")))
    lines = _dialogue(spark, d).groupBy("conv_id").agg(F.bool_or(F.col("role") == "user").alias("asked"), F.sort_array(F.collect_list(F.struct("turn", turn.alias("line")))).alias("lines"))
    whole = F.array_join("lines.line", "\n\n")
    return lines.where("asked").select("conv_id", F.sha2(whole, 256).alias("transcript_sha256"), F.length(whole).cast("long").alias("chars"))


def last_complete_exchange(spark, d):
    """Messages up to the last assistant message that a user's message follows."""
    per = Window.partitionBy("conv_id").orderBy("turn")
    marked = _dialogue(spark, d).withColumn("complete", (F.col("role") == "assistant") & (F.lead("role").over(per) == "user"))
    last = F.max(F.when(F.col("complete"), F.col("turn"))).over(Window.partitionBy("conv_id"))
    return marked.withColumn("last", last).where("turn <= last").select("conv_id", "turn", "role")


def middle_truncate(spark, d):
    cut = t.middle_truncated(F.col("text"), CUT)
    return table(spark, d, "documents").select("doc_id", F.length(cut).cast("long").alias("chars"), F.md5(cut).alias("cut_md5"))


def speaker_stats(spark, d):
    size = t.utf16_length(F.col("text"))
    agg = _dialogue(spark, d).groupBy("conv_id").agg(
        F.coalesce(F.sum(F.when(F.col("role") == "user", size)), F.lit(0)).alias("user_chars"),
        F.coalesce(F.sum(F.when(F.col("role") == "assistant", size)), F.lit(0)).alias("assistant_chars"),
        F.sum((size > CUT).cast("long")).alias("truncated"),
        F.min(F.struct("turn", "role")).alias("first"),
        F.array_size(F.collect_set("role")).cast("long").alias("n_speakers"),
    )
    return agg.select("conv_id", "user_chars", "assistant_chars", "truncated", F.col("first.role").alias("first_speaker"), "n_speakers")


def _cited(spark, d):
    """Documents with two groups of citations put before their text; every fifth id is unknown."""
    num = F.col("doc_id").cast("string")
    group = F.concat(F.lit("Said [a"), num, F.lit(", b"), (F.col("doc_id") % 5).cast("string"), F.lit("] and [b0].\n"))
    allowed = F.array(F.concat(F.lit("a"), num), F.lit("b1"), F.lit("b2"))
    return table(spark, d, "documents").select("doc_id", F.concat(group, F.col("text")).alias("text"), allowed.alias("allowed"))


def citations_extract(spark, d):
    found = t.citations(F.col("text"))
    return _cited(spark, d).select("doc_id", F.array_join(found, ",").alias("cited"), F.round(t.dropped_share(F.col("text"), F.col("allowed")), 6).alias("dropped"), F.md5(t.without_brackets(F.col("text"))).alias("plain_md5"))


def citations_clean(spark, d):
    return _cited(spark, d).select("doc_id", F.md5(t.citations_cleaned(F.col("text"), F.col("allowed"))).alias("cleaned_md5"))


def validation_report(spark, d):
    """What is wrong with each document taken as an observation: its first line, its language as kind."""
    docs = table(spark, d, "documents")
    fields = docs.select(
        "doc_id",
        F.element_at(F.split("text", "\n"), 1).alias("line"),
        F.when(F.col("n_chars") > 2000, " ").alias("body"),
        F.lit("user").alias("authority"),
        F.when(F.col("lang") == "en", "fact").when(F.col("lang") == "de", "question").otherwise(F.col("lang")).alias("kind"),
        (F.col("n_chars") / 3000.0).alias("confidence"),
        F.when(F.col("doc_id") % 3 == 0, "2024-02-30").otherwise("2024-02-03").alias("happened"),
        t.valid_slug(F.col("source")).alias("slug_ok"),
    )
    return fields.select("doc_id", field_problem().alias("problem"), "slug_ok")


QUERIES = {
    f.__name__: f
    for f in (
        doc_token_estimate, doc_normalized_terms, doc_vocab_df, line_chunks, chunk_neighbors, greedy_windows, firstfit_budget,
        content_dedup, conflict_groups, exclude_glob, longest_prefix_route, home_slug, transcript_render, last_complete_exchange,
        middle_truncate, speaker_stats, citations_extract, citations_clean, validation_report,
    )
}

_TOKENS = r"CAST((4 * len(list_filter(string_split_regex({}, '\s+'), lambda w: w <> '')) + 2) // 3 AS BIGINT)"
_TERMS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_CHUNKS = f"""
lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
chunks AS (
  SELECT doc_id, CAST((s - 1) // {CHUNK_LINES} AS INTEGER) AS chunk, CAST(s AS INTEGER) AS start_line, CAST(least(s + {CHUNK_LINES} - 1, len(l)) AS INTEGER) AS end_line,
         array_to_string(l[s:s + {CHUNK_LINES} - 1], chr(10)) AS text
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1, {CHUNK_LINES})) AS s FROM lines)
)"""
_PATHS = r"paths AS (SELECT page_id, regexp_extract(url, '^[^:]+://([^?#]*)', 1) AS path FROM pages)"
_CITED = r"""
cited AS (
  SELECT doc_id, 'Said [a' || doc_id || ', b' || (doc_id % 5) || '] and [b0].' || chr(10) || text AS text, ['a' || doc_id, 'b1', 'b2'] AS allowed FROM documents
), found AS (
  SELECT doc_id, text, allowed, list_distinct(['a' || doc_id, 'b' || (doc_id % 5), 'b0']) AS ids FROM cited
)"""

ORACLE_SQL = {
    "doc_token_estimate": f"SELECT doc_id, {_TOKENS.format('text')} AS tokens FROM documents",
    "doc_normalized_terms": f"SELECT doc_id, CAST(len({_TERMS}) AS BIGINT) AS n_terms, md5(array_to_string({_TERMS}, ' ')) AS normalized_md5 FROM documents",
    "doc_vocab_df": f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_TERMS})) AS term FROM documents) GROUP BY term",
    "line_chunks": f"WITH {_CHUNKS} SELECT doc_id, chunk, start_line, end_line, md5(text) AS text_md5 FROM chunks",
    "chunk_neighbors": f"""WITH {_CHUNKS}, ids AS (SELECT doc_id, chunk, 'src:' || doc_id || '/' || chunk AS chunk_id FROM chunks)
SELECT chunk_id, lag(chunk_id) OVER w AS previous, lead(chunk_id) OVER w AS next FROM ids WINDOW w AS (PARTITION BY doc_id ORDER BY chunk)""",
    "greedy_windows": f"""WITH RECURSIVE {_CHUNKS}, sized AS MATERIALIZED (SELECT doc_id, chunk, {_TOKENS.format('text')} AS tokens FROM chunks),
walk AS (
  SELECT doc_id, chunk, tokens, 0::BIGINT AS "window", tokens AS used FROM sized WHERE chunk = 0
  UNION ALL
  SELECT s.doc_id, s.chunk, s.tokens, CASE WHEN w.used > 0 AND w.used + s.tokens > {WINDOW_TOKENS} THEN w."window" + 1 ELSE w."window" END,
         CASE WHEN w.used > 0 AND w.used + s.tokens > {WINDOW_TOKENS} THEN s.tokens ELSE w.used + s.tokens END
  FROM walk w JOIN sized s ON s.doc_id = w.doc_id AND s.chunk = w.chunk + 1
)
SELECT doc_id, chunk, tokens, "window" FROM walk""",
    "firstfit_budget": f"""WITH RECURSIVE sized AS MATERIALIZED (
  SELECT conv_id, turn, {_TOKENS.format('text')} AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations
), walk AS (
  SELECT conv_id, turn, tokens, n, CASE WHEN tokens <= {BUDGET} THEN tokens END AS used, CASE WHEN tokens <= {BUDGET} THEN tokens ELSE 0 END AS total FROM sized WHERE n = 1
  UNION ALL
  SELECT s.conv_id, s.turn, s.tokens, s.n, CASE WHEN w.total + s.tokens <= {BUDGET} THEN w.total + s.tokens END, CASE WHEN w.total + s.tokens <= {BUDGET} THEN w.total + s.tokens ELSE w.total END
  FROM walk w JOIN sized s ON s.conv_id = w.conv_id AND s.n = w.n + 1
)
SELECT conv_id, turn, tokens, used FROM walk""",
    "content_dedup": "SELECT sha256('document' || chr(0) || text) AS hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1",
    "conflict_groups": "SELECT sha256('document' || chr(0) || text) AS hash, count(DISTINCT {'lang': lang, 'source': source}) AS payloads FROM documents GROUP BY 1 HAVING count(DISTINCT {'lang': lang, 'source': source}) > 1",
    "exclude_glob": rf"WITH {_PATHS} SELECT page_id, regexp_matches(trim(path, '/') || '/', '^([^/]+/)*fr/[^/]*/$') AS french, regexp_matches(trim(path, '/') || '/', '^[^/]*/en/[^/][^/]*/$') AS english FROM paths",
    "longest_prefix_route": f"""WITH {_PATHS}, routes(root, home) AS (VALUES {', '.join(str(r) for r in ROUTES)})
SELECT page_id, arg_max(home, length(root)) AS home FROM paths JOIN routes ON starts_with(path, root) GROUP BY page_id""",
    "home_slug": rf"""WITH {_PATHS}, slugs AS (SELECT page_id, trim(regexp_replace(lower(regexp_extract(regexp_replace(path, '/+$', ''), '([^/]*)$', 1)), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM paths)
SELECT page_id, CASE WHEN regexp_matches(s, '^[a-z][a-z0-9-]{{1,63}}$') THEN s END AS slug FROM slugs""",
    "transcript_render": r"""WITH lines AS (
  SELECT conv_id, string_agg(role || ':' || chr(10) || regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'), chr(10) || chr(10) ORDER BY turn) AS whole, bool_or(role = 'user') AS asked
  FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id
)
SELECT conv_id, sha256(whole) AS transcript_sha256, CAST(length(whole) AS BIGINT) AS chars FROM lines WHERE asked""",
    "last_complete_exchange": """WITH marked AS (
  SELECT conv_id, turn, role, role = 'assistant' AND lead(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'user' AS complete
  FROM conversations WHERE role IN ('user', 'assistant')
), last AS (SELECT *, max(turn) FILTER (complete) OVER (PARTITION BY conv_id) AS last FROM marked)
SELECT conv_id, turn, role FROM last WHERE turn <= last""",
    "middle_truncate": f"""WITH cut AS (
  SELECT doc_id, CASE WHEN length(text) > {CUT} THEN left(text, {(CUT - 5) // 3}) || chr(10) || '...' || chr(10) || right(text, {CUT - 5 - (CUT - 5) // 3}) ELSE text END AS c FROM documents
)
SELECT doc_id, CAST(length(c) AS BIGINT) AS chars, md5(c) AS cut_md5 FROM cut""",
    "speaker_stats": f"""SELECT conv_id, CAST(coalesce(sum(length(text)) FILTER (role = 'user'), 0) AS BIGINT) AS user_chars,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS assistant_chars,
  CAST(sum(CASE WHEN length(text) > {CUT} THEN 1 ELSE 0 END) AS BIGINT) AS truncated, arg_min(role, turn) AS first_speaker, count(DISTINCT role) AS n_speakers
FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id""",
    "citations_extract": rf"""WITH {_CITED}
SELECT doc_id, 'a' || doc_id || ',b' || (doc_id % 5) || CASE WHEN doc_id % 5 = 0 THEN '' ELSE ',b0' END AS cited,
       round(len(list_filter(ids, lambda x: NOT list_contains(allowed, x))) / len(ids), 6) AS dropped,
       md5(regexp_replace(text, '\s*\[[^\[\]]*\]', '', 'g')) AS plain_md5
FROM found""",
    "citations_clean": rf"""WITH {_CITED}
SELECT doc_id, md5(regexp_replace('Said [a' || doc_id || CASE WHEN doc_id % 5 IN (1, 2) THEN ', b' || (doc_id % 5) ELSE '' END || '] and .' || substr(text, strpos(text, chr(10))), '[ \t]+([.,;:!?]|\n|$)', '\1', 'g')) AS cleaned_md5
FROM found""",
    "validation_report": r"""SELECT doc_id, CASE
    WHEN trim(string_split(text, chr(10))[1]) = '' THEN 'line must not be empty'
    WHEN n_chars > 2000 THEN 'body must not be empty'
    WHEN lang NOT IN ('en', 'de') THEN 'unknown kind'
    WHEN n_chars / 3000.0 > 1 THEN 'confidence must be between 0 and 1'
    WHEN doc_id % 3 = 0 THEN 'happened is not a date' END AS problem,
  regexp_matches(source, '^[a-z][a-z0-9-]{1,63}$') AS slug_ok
FROM documents""",
}
