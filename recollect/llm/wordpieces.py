"""Token ids of texts by way of their words, each encoded once while it is remembered."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words remembered by a task, and bytes of text that are split at once.
REMEMBERED, CHUNK = 300_000, 4 << 20


def chunks(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, pa.Array]]:
    """Runs of ``texts`` of about ``most`` bytes, with the place of each run's first text; nulls become empty.

    A longer text is a run of its own. Bytes that are no UTF-8 become replacement characters.
    """
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        run = texts.slice(start, end - start)
        try:
            yield start, run.cast(pa.large_string())
        except pa.ArrowInvalid:
            yield start, pa.array([x.decode("utf-8", "replace") for x in run.to_pylist()], pa.large_string())
        start = end


def _list(strings: pa.Array) -> list[str]:
    """The same as to_pylist, by way of numpy, which is several times as fast."""
    return strings.to_numpy(zero_copy_only=False).tolist()


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` that begin at ``starts``, one after the other, and where each ends."""
    ends = np.cumsum(sizes, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    # Half the memory where that is wide enough.
    width = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    at = np.repeat((starts - ends + sizes).astype(width), sizes)
    at += np.arange(total, dtype=width)
    return flat[at], ends


class Words:
    """The words of a run of texts: text i has the numbers ``places[starts[i]:starts[i + 1]]``."""

    def __init__(self, table: WordTable, starts: np.ndarray, places: np.ndarray):
        self.starts, self.places = starts, places
        self.ids, ends = _gathered(table.flat, table.starts[places], table.sizes[places])
        self.id_starts = np.concatenate([[0], ends])[starts]

    def ids_of(self, i: int) -> np.ndarray:
        return self.ids[self.id_starts[i] : self.id_starts[i + 1]]

    def places_of(self, i: int) -> np.ndarray:
        return self.places[self.starts[i] : self.starts[i + 1]]


class WordTable:
    """Ids of words in one flat array, and, where ``counted``, their code points and their letters and digits.

    ``encode`` turns a list of words into all their ids and how many each has. Only
    encoders for which a text's ids are those of its white-space-separated words, one
    after the other, may be used. A table belongs to one task, so that its memory goes
    with it, and once it holds ``REMEMBERED`` words it keeps those that the run of texts
    at hand shares with earlier ones.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], counted: bool = False):
        self.encode, self.counted = encode, counted
        self.at: dict[str, int] = {}
        self.flat, self.starts = np.empty(0, np.uint32), np.empty(0, np.int64)
        self.sizes, self.points, self.letters = (np.empty(0, np.int32) for _ in range(3))

    def _keep(self, words: list[str]) -> None:
        """Forgets all but these words of the table."""
        at = np.fromiter((self.at[w] for w in words), np.int64, len(words))
        self.sizes = self.sizes[at]
        self.flat, ends = _gathered(self.flat, self.starts[at], self.sizes)
        self.starts, self.at = ends - self.sizes, dict(zip(words, range(len(words)), strict=True))
        if self.counted:
            self.points, self.letters = self.points[at], self.letters[at]

    def _learn(self, words: list[str]) -> None:
        ids, sizes = self.encode(words)
        starts = np.cumsum(sizes, dtype=np.int64) - sizes + len(self.flat)
        self.at.update(zip(words, range(len(self.at), len(self.at) + len(words)), strict=True))
        self.flat, self.starts = np.concatenate([self.flat, ids.astype(np.uint32)]), np.concatenate([self.starts, starts])
        self.sizes = np.concatenate([self.sizes, sizes.astype(np.int32)])
        if self.counted:
            points = np.fromiter(map(len, words), np.int32, len(words))
            letters = np.fromiter((len(w) if w.isalnum() else len(w) - 1 if w[:-1].isalnum() else sum(map(str.isalnum, w)) for w in words), np.int32, len(words))
            self.points, self.letters = np.concatenate([self.points, points]), np.concatenate([self.letters, letters])

    def words(self, texts: pa.Array) -> Words:
        """The words of a run of texts and their ids; numbers are valid until the next call."""
        split = pc.ascii_split_whitespace(texts)
        starts, values = split.offsets.to_numpy().astype(np.int64), split.values
        if pc.any(pc.equal(pc.binary_length(values), 0)).as_py():
            # White space at a text's ends leaves empty words.
            real = pc.greater(pc.binary_length(values), 0)
            starts = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])[starts]
            values = values.filter(real)
        coded = values.dictionary_encode()
        distinct, indices = _list(coded.dictionary), coded.indices.to_numpy()
        # What Arrow made is not needed beside the ids.
        del split, values, coded
        found = list(map(self.at.get, distinct))
        if None in found:
            if len(self.at) >= REMEMBERED:
                self._keep([w for w, f in zip(distinct, found, strict=True) if f is not None])
            self._learn([w for w, f in zip(distinct, found, strict=True) if f is None])
            found = list(map(self.at.__getitem__, distinct))
        return Words(self, starts, np.array(found, np.int32)[indices])


def _joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((x for own in lists for x in own), np.uint32, int(sizes.sum())), sizes


@lru_cache(maxsize=1)
def _model(load: Callable, path: str):
    """The model that ``load`` reads; a worker keeps only the last, since it serves one stage after the other."""
    return load(path)


def _piece_model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, np.array([model.IsByte(i) for i in range(model.vocab_size())])


def piece_table(path: str) -> tuple[WordTable, np.ndarray]:
    """An empty table of a SentencePiece model, and whether each id stands for a byte; workers keep the model."""
    model, is_byte = _model(_piece_model, path)
    return WordTable(lambda words: _joined(model.encode(words, num_threads=1)), counted=True), is_byte


def _byte_letters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself if it is visible, else one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordEnds:
    """Encodes words for a tokenizers file that lower-cases, drops white space and marks the ends of pieces.

    Words of printable characters below U+0180 need no more of its normalising than
    lower-casing; they are cut into pieces here, and each different piece goes once to
    its merging model, many in one call, which spares most of the cost of a whole
    encoding. All other words are left to the tokenizer as it is.
    """

    #: Words with other characters, or with the opening of a special token, are not plain.
    PLAIN = "^[!-~¡-įı-ſ]+$"
    #: Pieces joined into one call of the model.
    AT_ONCE = 5_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        # Both share one model in memory.
        self.merging = Tokenizer(self.whole.model)
        self.merging.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.is_end = np.zeros(self.whole.get_vocab_size(), bool)
        self.is_end[[i for t, i in self.whole.get_vocab().items() if t.endswith("</w>")]] = True
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items() if b != 32})
        plain = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x180))]
        alphabet, numbers = ("".join(c for c in plain if unicodedata.category(c)[0] == k) for k in "LN")
        self.pieces = re.compile(f"\n|'s|'t|'re|'ve|'m|'ll|'d|[{alphabet}]+|[{numbers}]|[^\n{alphabet}{numbers}]+")

    def _merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces and how many each has; every piece's last id, and no other, is an end."""
        found = []
        for i in range(0, len(pieces), self.AT_ONCE):
            text = " ".join(pieces[i : i + self.AT_ONCE]).encode().decode("latin-1").translate(self.letters)
            found.append(np.array(self.merging.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32))
        ids = np.concatenate(found) if found else np.empty(0, np.uint32)
        ends = np.flatnonzero(self.is_end[ids]) + 1
        if len(ends) != len(pieces):
            raise ValueError("the vocabulary does not mark the ends of pieces")
        return ids, np.diff(ends, prepend=0)

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut = pa.array(self.pieces.findall("\n".join([*words, ""]).lower()), pa.large_string()).dictionary_encode()
        pieces, places = _list(cut.dictionary), cut.indices.to_numpy()
        line = pieces.index("\n")
        ids, sizes = self._merged(pieces[:line] + pieces[line + 1 :])
        sizes = np.insert(sizes, line, 0)
        flat, ends = _gathered(ids, (np.cumsum(sizes) - sizes)[places], sizes[places])
        return flat, np.diff(ends[places == line], prepend=0)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        array = pa.array(words, pa.large_string())
        plain = pc.and_(pc.match_substring_regex(array, self.PLAIN), pc.invert(pc.match_substring(array, "<|"))).to_numpy(zero_copy_only=False)
        if plain.all():
            return self._plain(words)
        odd = [w for w, p in zip(words, plain, strict=True) if not p]
        others = _joined([e.ids for e in self.whole.encode_batch_fast(odd, add_special_tokens=False)])
        if not plain.any():
            return others
        first = self._plain([w for w, p in zip(words, plain, strict=True) if p])
        flat, sizes = (np.concatenate([x, y]) for x, y in zip(first, others, strict=True))
        order = np.empty(len(words), np.int64)
        order[np.flatnonzero(plain)] = np.arange(plain.sum())
        order[np.flatnonzero(~plain)] = plain.sum() + np.arange(len(odd))
        return _gathered(flat, (np.cumsum(sizes) - sizes)[order], sizes[order])[0], sizes[order]


def bpe_table(path: str) -> WordTable:
    """An empty table of a tokenizers file; workers keep the model."""
    return WordTable(_model(WordEnds, path))
