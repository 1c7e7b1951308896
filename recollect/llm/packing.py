"""Hierarchical packing of documents into sequences of several lengths.

Documents longer than the largest window give whole windows; what is left of them,
and every shorter document, goes to the smallest tier that holds it. Each tier's
windows start from one of its documents; their gaps take the longest documents of
shorter tiers that fit, and a last gap is closed by cutting one. Only full windows
leave; what does not fill one waits for more documents. The end of a partition is
written as windows of falling powers of two, so there is no padding at all. Windows
of a tier are dealt into step groups of equal tokens, but for a partition's last of each
size, so that the groups' attention costs, the sums of squared piece lengths, are
balanced.

Scale: tokens are made and packed in the task that read the documents, at most
``GROUP`` tokens and one document at a time; no shuffle. The numbering of sequences
starts from the partition, so a repeated task gives the same rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.shared import lean
from recollect.llm.wordpieces import WordTable, bpe_table, chunks

TIERS = (4096, 2048, 1024, 512)
WINDOW, END, GROUP, STEP = TIERS[0], 2, 1 << 20, 8 * TIERS[0]
#: Room for the sequences of one partition.
PER_PARTITION = 1 << 40


def documents_ids(texts: pa.Array, table: WordTable) -> Iterator[np.ndarray]:
    """For each text the tokenizer's ids and the end-of-document id.

    The tokenizer lower-cases, which is done to A-Z first, so that fewer different words
    are met, but for texts with the opening of a special token.
    """
    for _, run in chunks(texts):
        words = table.words(pc.if_else(pc.match_substring(run, "<|"), run, pc.ascii_lower(run)))
        for i in range(len(run)):
            yield np.append(words.ids_of(i), np.uint32(END))
        # Else the next run's words would be made beside these.
        del words


class Packer:
    """Packs pieces (length, number, start) of numbered documents into windows."""

    def __init__(self):
        self.pools: dict[int, list] = {t: [] for t in TIERS}
        self.waiting = 0

    def add(self, number: int, length: int) -> list[tuple[int, list]]:
        """Takes in a document; gives the whole windows it fills by itself."""
        whole = length // WINDOW
        if rest := length - whole * WINDOW:
            self._put((rest, number, whole * WINDOW))
        return [(WINDOW, [(WINDOW, number, i * WINDOW)]) for i in range(whole)]

    def _put(self, piece: tuple) -> None:
        insort(self.pools[self._tier(piece[0])], piece)
        self.waiting += piece[0]

    @staticmethod
    def _tier(length: int) -> int:
        return min(t for t in TIERS if t >= length)

    def _take(self, tier: int, at: int) -> tuple:
        piece = self.pools[tier].pop(at)
        self.waiting -= piece[0]
        return piece

    def _fill(self, window: list, gap: int) -> None:
        while gap:
            for tier in sorted((t for t in TIERS if self.pools[t]), reverse=True):
                at = bisect_right(self.pools[tier], (gap, float("inf"), 0)) - 1
                if at >= 0:
                    window.append(self._take(tier, at))
                    break
            else:
                # All that wait are longer than the gap: cut the shortest.
                length, number, start = self._take(min(t for t in TIERS if self.pools[t]), 0)
                window.append((gap, number, start))
                self._put((length - gap, number, start + gap))
            gap -= window[-1][0]

    def full(self) -> list[tuple[int, list]]:
        """Windows of all tiers that can be filled from what waits."""
        out = []
        for tier in TIERS:
            while self.pools[tier] and self.waiting >= tier:
                window = [self._take(tier, len(self.pools[tier]) - 1)]
                self._fill(window, tier - window[0][0])
                out.append((tier, window))
        return out

    def rest(self) -> list[tuple[int, list]]:
        """All that waits, in windows of falling powers of two."""
        out = self.full()
        while self.waiting:
            size = 1 << min(self.waiting.bit_length() - 1, WINDOW.bit_length() - 1)
            window: list = []
            self._fill(window, size)
            out.append((size, window))
        return out


class StepGroups:
    """Deals windows into step groups, numbered from ``first``.

    A group holds windows of one size, exactly ``STEP`` tokens of them; windows that do
    not fill a group wait for more, and only the last group of a size may be smaller. Of
    the groups made at once, the costliest windows are dealt out there and back.
    """

    def __init__(self, first: int):
        self.next, self.waiting = first, {}

    def add(self, size: int, pieces: list, rows: list) -> None:
        self.waiting.setdefault(size, []).append((sum(p[0] ** 2 for p in pieces), rows))

    def take(self, last: bool = False) -> list[tuple]:
        """The rows of all full groups, and with ``last`` of the rest, each with its group's number."""
        out = []
        for size in sorted(self.waiting, reverse=True):
            own, n = self.waiting[size], len(self.waiting[size]) * size // STEP
            whole, self.waiting[size] = own[: n * STEP // size], own[n * STEP // size :]
            for k, (_, rows) in enumerate(sorted(whole, key=lambda w: -w[0])):
                turn = k % (2 * n)
                out += [(*row, self.next + (turn if turn < n else 2 * n - 1 - turn)) for row in rows]
            self.next += n
            if last and self.waiting[size]:
                out += [(*row, self.next) for _, rows in self.waiting.pop(size) for row in rows]
                self.next += 1
        return out


def _packed(vocabulary: str):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bpe_table(vocabulary)
        base = TaskContext.get().partitionId() * PER_PARTITION
        packer, steps, held, number, sequence = Packer(), StepGroups(base), {}, 0, base

        def rows(windows: list, last: bool = False) -> pa.RecordBatch:
            nonlocal sequence
            for size, window in windows:
                offset, own = 0, []
                for length, n, start in window:
                    doc_id, ids = held[n]
                    own.append((doc_id, start, length, zlib.crc32(ids[start : start + length].astype("<u4").tobytes()), len(ids), sequence, offset, size))
                    offset += length
                steps.add(size, window, own)
                sequence += 1
            columns = list(zip(*steps.take(last), strict=True)) or [()] * len(NAMES)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=NAMES)

        windows, fresh = [], 0
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), documents_ids(batch.column(1), table), strict=True):
                held[number] = (doc_id, ids)
                windows += packer.add(number, len(ids))
                number, fresh = number + 1, fresh + len(ids)
                if fresh >= GROUP:
                    yield rows(windows + packer.full())
                    waiting = {p[1] for pool in packer.pools.values() for p in pool}
                    held = {n: x for n, x in held.items() if n in waiting}
                    windows, fresh = [], 0
        yield rows(windows + packer.rest(), last=True)

    return run


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group"]


def packed(docs: DataFrame, vocabulary: str) -> DataFrame:
    """A row for each piece of a document in a sequence; window is the sequence's length.

    Nulls: a null or empty text is the end-of-document id alone; a null doc_id is
    carried. A text of any length is cut into as many windows as it fills. Documents of
    equal length are taken as they come. Rows that share an id, and repeated rows, are
    packed each on its own. An empty table gives no rows; other columns, whatever their
    names, are not read.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_packed(vocabulary), ", ".join(f"{n} long" for n in NAMES))
