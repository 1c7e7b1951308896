"""Quality rules with tokeniser fertility.

Besides simple counts of words, symbols, repeated lines and repeated three-word
windows, each text is measured with a public vocabulary: characters of its words for each
token, the share of tokens that are fallback bytes, and the entropy of the tokens in
bits. A further measure beside these counts letters and digits alone for each token, of
which texts full of marks and symbols have few.
A language, or where that is unknown the text's main script, has bands for the
four, Latin with many marks its own since marks cost tokens; a text outside its bands
is rejected. The vocabulary is read by every worker from ``vocabulary``; words are
encoded once while they are remembered.

Scale: one pass over each text in the task that read it, without any shuffle.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.llm.shared import lean
from recollect.llm.wordpieces import WordTable, chunks, piece_table

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEATED = 50, 50
#: Letters with marks in a hundred from which on Latin text is judged as Vietnamese, Yoruba and the like.
MARKED = 10


@dataclass(frozen=True)
class Band:
    """Least and most characters a token, most share of bytes, least entropy in bits, least letters and digits a token."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float
    least_letters: float


BANDS = {
    "en": Band(1.8, 6.5, 0.2, 4.0, 1.65),
    "de": Band(1.84, 6.5, 0.2, 4.0, 1.85),
    "fr": Band(1.51, 6.5, 0.2, 4.0, 1.5),
    "es": Band(1.62, 6.5, 0.2, 4.0, 1.65),
    "Latin": Band(1.3, 7.0, 0.3, 4.0, 1.3),
    "marked Latin": Band(0.65, 7.0, 0.3, 4.0, 0.65),
    "Greek": Band(0.6, 4.0, 0.6, 4.0, 0.6),
    "Cyrillic": Band(0.8, 5.0, 0.4, 4.0, 0.8),
    "Arabic": Band(0.5, 4.0, 0.6, 4.0, 0.5),
    "Han": Band(0.3, 2.0, 0.9, 4.0, 0.3),
    "other": Band(0.2, 8.0, 1.0, 3.0, 0.2),
}
#: First and last code points of the scripts' blocks; letters outside them are of another script.
SCRIPTS = {
    "Latin": ((0x41, 0x2AF), (0x1D00, 0x1D25), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA722, 0xA7FF), (0xAB30, 0xAB64), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)),
    "Greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "Cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0xA640, 0xA69F)),
    "Arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x870, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "Han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)),
}


@lru_cache(maxsize=1)
def _script_numbers() -> np.ndarray:
    """For each code point 0 where it is no letter, else its script's place in ``SCRIPTS``, from 1, or one more than those."""
    letters = np.fromiter((chr(x).isalpha() for x in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    numbers = np.full(len(letters), len(SCRIPTS) + 1, np.uint8)
    for i, blocks in enumerate(SCRIPTS.values(), 1):
        for first, last in blocks:
            numbers[first : last + 1] = i
    return numbers * letters


def _points(text: bytes) -> np.ndarray:
    return np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def script_of(text: bytes) -> str:
    """The script of most letters; other where that is none of ``SCRIPTS`` or there are no letters."""
    counts = np.bincount(_script_numbers()[_points(text)], minlength=len(SCRIPTS) + 2)[1:]
    return [*SCRIPTS, "other"][int(counts.argmax())] if counts.any() else "other"


def band_of(text: bytes, bands: dict[str, Band]) -> str:
    """The script, or marked Latin where ``MARKED`` percent of Latin letters are beyond ASCII or bear combining marks."""
    script = script_of(text)
    if script == "Latin" and "marked Latin" in bands:
        points = _points(text)
        latin = points[_script_numbers()[points] == 1]
        marks = int((latin > 0x7F).sum()) + int(((points >= 0x300) & (points <= 0x36F)).sum())
        if 100 * marks >= MARKED * len(latin):
            return "marked Latin"
    return script


def repeated_words(places: np.ndarray) -> int:
    """Words inside three-word windows that occur twice or more."""
    if len(places) < 4:
        return 0
    distinct, x = np.unique(places, return_inverse=True)
    _, pairs = np.unique(x[:-1] * len(distinct) + x[1:], return_inverse=True)
    _, windows, counts = np.unique(pairs[:-1] * len(distinct) + x[2:], return_inverse=True, return_counts=True)
    again = counts[windows] > 1
    inside = np.zeros(len(x), bool)
    for i in range(3):
        inside[i : len(x) - 2 + i] |= again
    return int(inside.sum())


def measures(texts: pa.Array, table: WordTable, is_byte: np.ndarray) -> Iterator[tuple[bytes, tuple]]:
    """Each text with its n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars a token, byte share, entropy and letters a token."""
    for _, run in chunks(texts):
        words = table.words(run)
        for i, text in enumerate(run.cast(pa.large_binary()).to_pylist()):
            places, ids = words.places_of(i), words.ids_of(i)
            n_symbols = len(text) - len(text.translate(None, SYMBOLS))
            if not len(places):
                yield text, (0, 0, n_symbols, 0, 0, None, None, None, None)
                continue
            lines = [x for x in text.split(b"\n") if x.strip()]
            base = (len(places), int(table.points[places].sum()), n_symbols, len(lines) - len(set(lines)), repeated_words(places))
            if not len(ids):
                yield text, (*base, None, None, None, None)
                continue
            _, counts = np.unique(ids, return_counts=True)
            share = counts / len(ids)
            yield text, (*base, base[1] / len(ids), float(is_byte[ids].mean()), max(0.0, float(-(share * np.log2(share)).sum())), int(table.letters[places].sum()) / len(ids))
        # Else the next run's words would be made beside these.
        del words


def _judged(vocabulary: str, bands: dict[str, Band], text_at: int, lang_at: int | None, carried: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, is_byte = piece_table(vocabulary)
        for batch in batches:
            rows = []
            langs = [None] * len(batch) if lang_at is None else batch.column(lang_at).to_pylist()
            for (text, m), lang in zip(measures(batch.column(text_at), table, is_byte), langs, strict=True):
                failed = m[0] < MIN_WORDS or 100 * m[4] > MAX_REPEATED * m[0]
                name = lang if lang in bands else band_of(text, bands)
                band = bands.get(name) or bands["other"]
                reason = None
                if not failed:
                    if m[5] is None or not band.least_chars <= m[5] <= band.most_chars:
                        reason = "chars_per_token"
                    elif m[6] > band.most_bytes:
                        reason = "byte_share"
                    elif m[7] < band.least_entropy:
                        reason = "token_entropy"
                    elif m[8] < band.least_letters:
                        reason = "letters_per_token"
                rows.append((*m, failed, not failed and reason is None, name, reason))
            columns = list(zip(*rows, strict=True)) or [()] * len(NAMES)
            kinds = [pa.int64()] * 5 + [pa.float64()] * 4 + [pa.bool_()] * 2 + [pa.string()] * 2
            out = [pa.array(x, k) for x, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:carried], *out], names=[*batch.schema.names[:carried], *NAMES])

    return run


def fitted_bands(judged: DataFrame, tail: float = 0.001, margin: float = 0.1, least: int = 1000) -> dict[str, Band]:
    """Bands from the measures of a table, as ``quality`` returns them.

    Of the rows that pass the base rules a share of ``tail`` lies below, or above, each
    limit before it is moved outwards by ``margin`` of itself. Quantiles are over all
    rows; languages and scripts of fewer than ``least`` rows keep the band they have.
    """
    passed = judged.where("not base_failed and chars_per_token is not null")
    cuts = [F.percentile_approx(c, F.array(F.lit(tail), F.lit(1 - tail)), 100_000).alias(c) for c in ("chars_per_token", "byte_share", "token_entropy", "letters_per_token")]
    # A row for each band, so a dozen or so.
    rows = passed.groupBy("band").agg(F.count("*").alias("n"), *cuts).where(F.col("n") >= least).collect()
    less, more = 1 - margin, 1 + margin
    return BANDS | {r["band"]: Band(less * r["chars_per_token"][0], more * r["chars_per_token"][1], min(1.0, more * r["byte_share"][1] + 0.01), less * r["token_entropy"][0], less * r["letters_per_token"][0]) for r in rows}


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars_per_token", "byte_share", "token_entropy", "letters_per_token", "base_failed", "kept", "band", "reason"]
_KINDS = [T.LongType()] * 5 + [T.DoubleType()] * 4 + [T.BooleanType()] * 2 + [T.StringType()] * 2


def quality(docs: DataFrame, vocabulary: str, carry: list[str], text_col: str = "text", lang_col: str | None = "lang", bands: dict[str, Band] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` and the measures and verdicts of its text.

    base_failed: fewer than ``MIN_WORDS`` words, or more than ``MAX_REPEATED`` percent
    of them in repeated windows. kept: not base_failed and inside the bands of the
    language or script; reason names the first band missed.

    Nulls: a null or empty text has no words and fails; without tokens the
    fertility measures are null. A null or unknown language falls back to the script; of
    scripts with equally many letters the first of ``SCRIPTS`` counts. Texts of any length
    are measured whole. Carried columns that bear a measure's name are dropped. Repeated
    rows are judged alike; an empty table stays empty.
    """
    carry = [c for c in carry if c not in NAMES]
    needed = [c for c in (text_col, lang_col) if c in docs.columns]
    framed = docs.select(*carry, *(c for c in dict.fromkeys(needed) if c not in carry))
    lang_at = framed.columns.index(lang_col) if lang_col in framed.columns else None
    schema = T.StructType([*framed.schema.fields[: len(carry)], *(T.StructField(n, k) for n, k in zip(NAMES, _KINDS, strict=True))])
    return framed.mapInArrow(_judged(vocabulary, bands or BANDS, framed.columns.index(text_col), lang_at, len(carry)), schema)
