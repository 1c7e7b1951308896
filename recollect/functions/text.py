"""Text measures and clean-ups as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed by the data contract: what each role may keep of a message, in UTF-16 units.
ASSISTANT_LIMIT, USER_LIMIT = 5_000, 100_000
ELLIPSIS = "\n...\n"


def words(text: Column) -> Column:
    """Runs without Unicode white space; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def token_estimate(text: Column) -> Column:
    """Four thirds of the words, rounded up."""
    return F.floor((F.size(words(text)) * 4 + 2) / 3).cast("long")


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def normalized(text: Column) -> Column:
    return F.array_join(terms(text), " ")


def numbered_lines(text: Column) -> Column:
    """Lines as number, tab, line; numbers from 1."""
    return F.transform(F.split(text, "\n"), lambda line, i: F.concat((i + 1).cast("string"), F.lit("\t"), line))


def line_slice(text: Column, start: Column, stop: Column) -> Column:
    """Lines start to stop, both counted from 1 and included; null outside the text."""
    lines = F.split(text, "\n")
    fits = (start >= 1) & (stop >= start) & (stop <= F.size(lines))
    return F.when(fits, F.array_join(F.slice(lines, F.greatest(start, F.lit(1)), F.greatest(stop - start + 1, F.lit(0))), "\n"))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def cleaned(text: Column) -> Column:
    """Without NULs, with plain line ends, at most one blank line in a row, trimmed."""
    plain = F.replace(F.replace(text, F.lit("\x00"), F.lit("")), F.lit("\r\n"), F.lit("\n"))
    return F.regexp_replace(F.regexp_replace(plain, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def middle_truncated(text: Column, limit: int) -> Column:
    """A third of the room from the head, the rest from the tail, an ellipsis between.

    Lengths are UTF-16 units; text beyond the basic plane is cut by code points, so
    that no pair is torn, and may keep a little less than the limit.
    """
    room = limit - len(ELLIPSIS)
    head = room // 3
    wide = utf16_length(text) - F.length(text)
    tail = F.greatest(F.lit(room - head) - wide, F.lit(0)).cast("int")
    cut = F.concat(F.left(text, F.lit(head)), F.lit(ELLIPSIS), F.right(text, tail))
    return F.when(utf16_length(text) > limit, cut).otherwise(text)


def message_cut(role: Column, text: Column, assistant_limit: int = ASSISTANT_LIMIT, user_limit: int = USER_LIMIT) -> Column:
    return F.when(role == "assistant", middle_truncated(text, assistant_limit)).otherwise(middle_truncated(text, user_limit))


def rendered_turn(stamp: Column, speaker: Column, text: Column) -> Column:
    """``[stamp ]speaker:`` and the text on the next line."""
    return F.concat(F.coalesce(F.concat(stamp, F.lit(" ")), F.lit("")), speaker, F.lit(":\n"), text)


def speakers(text: Column) -> Column:
    """Distinct labels at line starts, in order of appearance."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^([^:\n]{1,80}):\s"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.trim(x)))


def citations(text: Column) -> Column:
    """Ids inside brackets, split at commas, distinct in order of appearance."""
    groups = F.regexp_extract_all(text, F.lit(r"\[([^\[\]]*)\]"), F.lit(1))
    return F.array_distinct(F.filter(F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda x: F.trim(x)))), lambda x: x != ""))


def citations_cleaned(text: Column, allowed: Column) -> Column:
    """The text with ids outside ``allowed`` dropped and emptied groups removed.

    The text is walked as its pieces between and inside brackets, which alternate.
    """
    pieces = F.split(F.replace(F.replace(text, F.lit("["), F.lit("\x01[")), F.lit("]"), F.lit("]\x01")), "\x01")

    def one(piece: Column) -> Column:
        inner = F.filter(F.transform(F.split(F.regexp_replace(piece, r"[\[\]]", ""), ","), lambda x: F.trim(x)), lambda x: F.array_contains(allowed, x))
        group = F.when(F.size(inner) > 0, F.concat(F.lit("["), F.array_join(inner, ", "), F.lit("]"))).otherwise("")
        return F.when(piece.rlike(r"^\[[^\[\]]*\]$"), group).otherwise(F.regexp_replace(piece, r"[\[\]]", ""))

    return F.regexp_replace(F.array_join(F.transform(pieces, one), ""), r"[ \t]+(?=[.,;:!?]|\n|$)", "")


def dropped_share(text: Column, allowed: Column) -> Column:
    """Share of the cited ids that are not allowed; 0 without citations."""
    found = citations(text)
    outside = F.size(F.array_except(found, allowed))
    return F.when(F.size(found) > 0, outside / F.size(found)).otherwise(F.lit(0.0))


def without_brackets(text: Column) -> Column:
    """Without bracket groups and the white space before them."""
    return F.regexp_replace(text, r"\s*\[[^\[\]]*\]", "")


def standing_ids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\b([0-9a-f]{8})\b"), F.lit(1))


def home_slug(path: Column) -> Column:
    """The last path segment as a slug of 2 to 64 characters; null where none can be made."""
    leaf = F.lower(F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1))
    slug = F.regexp_replace(F.regexp_replace(leaf, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(valid_slug(slug), slug)


def valid_slug(slug: Column) -> Column:
    return F.coalesce(slug.rlike("^[a-z][a-z0-9-]{1,63}$"), F.lit(False))


def flat_content(content: Column) -> Column:
    """A message's content, a JSON string or array of blocks, as plain text."""
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(blocks, lambda b: b["type"].isin("text", "input_text", "output_text")), lambda b: F.coalesce(b["text"], F.lit("")))
    plain = F.from_json(F.concat(F.lit("["), content, F.lit("]")), "array<string>")[0]
    return F.when(F.ltrim(content).startswith("["), F.array_join(texts, "\n")).when(F.ltrim(content).startswith('"'), plain).otherwise(F.lit(""))


def observation_text(line: Column, body: Column) -> Column:
    return F.concat_ws("\n\n", line, body)


def rendered_line(id_: Column, bucket: Column, has_body: Column, line: Column, n_sources: Column, date: Column) -> Column:
    """``- id [bucket+] line (sources; date)``."""
    return F.concat(F.lit("- "), id_, F.lit(" ["), bucket.cast("string"), F.when(has_body, "+").otherwise(""), F.lit("] "), line, F.lit(" ("), n_sources.cast("string"), F.coalesce(F.concat(F.lit("; "), date), F.lit("")), F.lit(")"))


def without_keys(payload: Column, *keys: str) -> Column:
    """A JSON object, as a map of strings, without retired keys."""
    return F.map_filter(F.from_json(payload, "map<string,string>"), lambda k, v: ~k.isin(*keys))
