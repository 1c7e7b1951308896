"""URL rules as globs in one bit-parallel Shift-And automaton.

A glob is literal characters with two wildcards, ``*`` for any run and ``+`` for any run
without a slash, the empty one too. Its states, one more than its literals, take
neighbouring bits of a multiword mask; all globs advance at once:

    D = ((D << 1) & match[c]) | (D & stay[c])

with match[c] the states entered by c and stay[c] those whose wildcard swallows c.
The masks grow with the rules, not with the data, and go with each task; URLs are
simulated column by column for a whole Arrow batch, and a URL leaves the batch as
soon as no state but finished ones can change. There is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANY, NO_SLASH = "*", "+"


@dataclass(frozen=True)
class Rule:
    """Allows or blocks a host, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> list[list[str]]:
        """Tokens for the host itself and for its subdomains."""
        tail = [*self.host, *self.path, "\0" + ANY]
        return [tail, ["\0" + NO_SLASH, ".", *tail]]


def parse_glob(glob: str) -> list[str]:
    """Tokens of a glob: ``*`` and ``+`` are wildcards, a backslash makes the next character plain."""
    out, chars = [], iter(glob)
    for c in chars:
        out.append(next(chars, "\\") if c == "\\" else "\0" + c if c in (ANY, NO_SLASH) else c)
    return out


class ShiftAnd:
    """All globs in one automaton; ``globs`` are lists of tokens."""

    def __init__(self, globs: list[list[str]]):
        literals = sorted({t for g in globs for t in g if t[0] != "\0"} | {"/"})
        #: Characters no glob names share the class 0.
        self.points = np.array([ord(c) for c in literals], np.uint32)
        n_bits = sum(1 + sum(t[0] != "\0" for t in g) for g in globs)
        self.words = -(-max(1, n_bits) // 64)
        shape = (len(literals) + 1, self.words)
        self.match, self.stay = np.zeros(shape, np.uint64), np.zeros(shape, np.uint64)
        self.start, self.live = np.zeros(self.words, np.uint64), np.zeros(self.words, np.uint64)
        self.ends: list[tuple[int, np.uint64]] = []
        slash, bit = literals.index("/") + 1, 0
        for g in globs:
            self._set(self.start, bit)
            first = bit
            for t in g:
                if t[0] == "\0":
                    for c in range(len(literals) + 1):
                        if t[1] == ANY or c != slash:
                            self._set(self.stay[c], bit)
                else:
                    bit += 1
                    self._set(self.match[literals.index(t) + 1], bit)
            self.ends.append((bit // 64, np.uint64(1) << np.uint64(bit % 64)))
            for b in range(first, bit + 1):
                if not (b == bit and g and g[-1] == "\0" + ANY):
                    self._set(self.live, b)
            bit += 1

    @staticmethod
    def _set(mask: np.ndarray, bit: int) -> None:
        mask[bit // 64] |= np.uint64(1) << np.uint64(bit % 64)

    def run(self, urls: list[str]) -> np.ndarray:
        """A row for each URL and a column for each glob: whether it matches."""
        lengths = np.fromiter(map(len, urls), np.int64, len(urls))
        flat = np.frombuffer("".join(urls).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.searchsorted(self.points, flat)
        at[at == len(self.points)] = 0
        classes = np.where(self.points[at] == flat, at + 1, 0)
        offsets = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        state = np.tile(self.start, (len(urls), 1))
        alive, step = np.flatnonzero(lengths > 0), 0
        while len(alive):
            c = classes[offsets[alive] + step]
            d = state[alive]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            d = (moved & self.match[c]) | (d & self.stay[c])
            state[alive] = d
            step += 1
            alive = alive[(lengths[alive] > step) & (d & self.live).any(axis=1)]
        return np.stack([(state[:, w] & b) != 0 for w, b in self.ends], axis=1) if self.ends else np.zeros((len(urls), 0), bool)


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased and path; both empty without ``://``."""
    rest = (url or "").partition("://")[2]
    host_end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path_end = min((i for i in map(lambda c: rest.find(c, host_end), "?#") if i >= 0), default=len(rest))
    host = rest[:host_end].encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    return host, rest[host_end:path_end]


def _judged(rules: list[Rule], block_globs: list[str], default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        globs = [g for r in rules for g in r.globs()]
        automaton = ShiftAnd([*globs, *map(parse_glob, block_globs)])
        # Longest first, so that the first that fits wins; ties go to the earlier rule.
        order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), i))
        ranked = [rules[i] for i in order]
        for batch in batches:
            parts = [host_and_path(u) for u in batch.column(batch.schema.names.index("__url")).to_pylist()]
            hits = automaton.run([h + p for h, p in parts])
            fits = (hits[:, 0 : len(globs) : 2] | hits[:, 1 : len(globs) : 2])[:, order]
            won = np.where(fits.any(axis=1), fits.argmax(axis=1), len(rules)) if rules else np.zeros(len(hits), np.int64)
            blocked = hits[:, len(globs) :].any(axis=1)
            names = [ranked[i].name if i < len(rules) else None for i in won]
            verdicts = [ranked[i].verdict if i < len(rules) else "block" if b else default for i, b in zip(won, blocked, strict=True)]
            kept = [i for i, x in enumerate(batch.schema.names) if x != "__url"]
            added = [pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array(names, pa.string()), pa.array(verdicts, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *added], names=[*(batch.schema.names[i] for i in kept), "host", "path", "rule", "verdict"])

    return run


#: Words that, between dots or hyphens of a host, tell of a site that sells or streams
#: what no corpus wants.
SPAM_WORDS = ("bets", "casino", "jackpot", "payday", "pills", "poker", "porn", "torrents", "viagra", "xxx")
#: Endings of paths that lead to no text, and parts of paths that lead to forms and lists.
NO_TEXT = ("7z", "apk", "avi", "bin", "css", "exe", "gif", "gz", "ico", "iso", "jpeg", "jpg", "js", "mov", "mp3", "mp4", "png", "rar", "svg", "tar", "wav", "webp", "woff", "zip")
NO_PROSE = ("/cart/", "/checkout/", "/login/", "/search/", "/signup/", "/tag/", "/wp-admin/", "/wp-login")


def default_globs() -> list[str]:
    """The method's own rules, over host and path: spam hosts, files without text, forms."""
    hosts = [f"{before}{word}{after}*" for word in SPAM_WORDS for before in ("", "+.", "+-") for after in ".-"]
    return [*hosts, *(f"*/*.{end}" for end in NO_TEXT), *(f"*{part}*" for part in NO_PROSE)]


def judge_urls(pages: DataFrame, rules: list[Rule], url_col: str = "url", block_globs: list[str] | None = None, default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict of the URL.

    The longest rule that fits decides; else a match of ``block_globs`` (globs over
    host and path) blocks, and what is left gets ``default``.

    Nulls: a null URL, or one without ``://``, has an empty host and path, which only
    globs can match. URLs of any length are read to their end. Of rules of equal length
    the first wins. Repeated rows are judged alike; an empty table stays empty.
    Columns named host, path, rule or verdict are replaced, all others are carried.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    framed = pages.select(*kept, F.col(url_col).alias("__url"))
    fields = [f for f in framed.schema.fields if f.name != "__url"]
    schema = T.StructType([*fields, *(T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict"))])
    return framed.mapInArrow(_judged(rules, block_globs or [], default), schema)
