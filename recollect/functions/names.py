"""Fuzzy matching of names and glob patterns as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed by the matching rule: what a shared prefix is worth and how long it has to be.
PREFIX_SCORE, PREFIX_LENGTH, PREFIX_SHARE, DEPTH_DISCOUNT = 0.8, 5, 0.6, 0.85


def plain_name(name: Column) -> Column:
    """Lower-cased letters and digits alone."""
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]", ""))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two strings."""
    places = F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1)))
    same = F.filter(places, lambda i: (F.length(a) >= i) & (F.left(a, i) == F.left(b, i)))
    return F.size(same)


def name_score(a: Column, b: Column) -> Column:
    """1 less the edit distance by the longer length; a long shared prefix is worth 0.8.

    Names with fewer than three letters or digits score 0.
    """
    x, y = plain_name(a), plain_name(b)
    longer, shorter = F.greatest(F.length(x), F.length(y)), F.least(F.length(x), F.length(y))
    base = 1 - F.levenshtein(x, y) / longer
    prefix = common_prefix(x, y)
    long_prefix = (prefix >= PREFIX_LENGTH) & (prefix >= PREFIX_SHARE * shorter)
    return F.when(shorter < 3, 0.0).when(long_prefix, F.greatest(base, F.lit(PREFIX_SCORE))).otherwise(base)


def glob_regex(pattern: str) -> str:
    """A segment glob as a regular expression; ``**`` spans any number of segments, none too."""
    out = []
    for segment in pattern.strip("/").split("/"):
        if segment == "**":
            out.append("(?:[^/]+/)*")
            continue
        piece = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in segment)
        out.append(piece + "/")
    return "^" + "".join(out) + "$"


def glob_match(path: Column, pattern: str) -> Column:
    return F.concat(F.regexp_replace(path, "^/+|/+$", ""), F.lit("/")).rlike(glob_regex(pattern))
