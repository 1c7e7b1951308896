"""Passages that stand in a corpus twice, by prefix-free parsing.

A rolling hash of ``GRAM`` bytes triggers where it is divisible by ``RARE``; from trigger
to trigger a text is cut into phrases that overlap by the trigger. A string of ``LENGTH``
bytes is then a suffix of a phrase up to its first trigger and what follows from there, so
the order of all such strings in the corpus is that of the phrases' suffixes, the
dictionary's, and within equal ones that of the continuations, the parse's. Strings
without such a trigger take their first one of the denser kind, ``DENSE``, and those
without either stand for themselves.

The strings of a phrase with the same trigger, up to ``SPAN`` of them, are a block. Copies
of a block, whose whole text is equal, are settled at once, so a text that repeats is
ordered once however often it stands there. All strings of a block contain its core, that
many bytes at a fixed place around the trigger; a block whose core is nowhere else is
settled as well. What is left, mostly the ends of passages, has its texts fetched and its
suffixes and continuations sorted among the blocks of the same core.

Scale: of a block one row of a few numbers is shuffled, of about fifty bytes of text;
texts meet their rows twice, by id. Counts are pre-aggregated and joined, so a core that
stands in a third of all documents is no task of its own, and one with more than ``MOST``
different blocks is compared string by string in place of being ordered.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.shared import stored

#: Fixed by the contract: bytes of a passage that repeats.
LENGTH = 200
#: Bytes of the rolling hash, its divisors for triggers, and the offsets to the trigger that one block takes.
GRAM, RARE, DENSE, SPAN = 16, 96, 32, 96
#: The largest offset of a trigger within a string, bytes worked on at once, and different blocks of a core in one task.
REACH, PIECE, MOST = LENGTH - GRAM, 1 << 20, 2048
#: Kinds of blocks: which trigger, and whether it is near or far; and strings without one.
NEAR, FAR, DENSE_NEAR, DENSE_FAR, BARE = range(1, 6)

_rng = np.random.default_rng(20250311)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_rng.integers(0, 2**63)) * 2 + 1
_U = np.uint64


def rolling(data: np.ndarray) -> np.ndarray:
    """The polynomial hash of the ``GRAM`` bytes from each place on, mixed."""
    if len(data) < GRAM:
        return np.empty(0, np.uint64)
    h, size = _BYTE[data], 1
    while size < GRAM:
        h = h[:-size] * _U(pow(_BASE, size, 2**64)) + h[size:]
        size *= 2
    h ^= h >> _U(31)
    h *= _U(0xBF58476D1CE4E5B9)
    return h >> _U(29)


def _chunks(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers of ranges, one range after the other."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(total)


def _gaps(ticks: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Strings by their first tick: (place, first string, last string) of each tick, and ranges (first, last) of strings without.

    ``first`` and ``last`` are disjoint ascending ranges of strings; a string takes a tick at
    an offset of at most ``REACH``.
    """
    a, b = np.searchsorted(ticks, first), np.searchsorted(ticks, last + REACH, "right")
    n = b - a
    owner = np.repeat(np.arange(len(first)), n)
    at = _chunks(a, n)
    tick = ticks[at]
    # A range's own ticks part it; its first one has the range's begin before it.
    begins = np.where(at == a[owner], first[owner], ticks[at - 1] + 1 if len(ticks) else 0)
    low, high = np.maximum(begins, tick - REACH), np.minimum(tick, last[owner])
    held = low <= high
    empty_low, empty_high = begins, np.minimum(tick - REACH - 1, last[owner])
    # Behind the last tick, or all of a range without one.
    tail_low = np.where(n > 0, (ticks[np.maximum(b - 1, 0)] if len(ticks) else np.zeros(len(b), np.int64)) + 1, first)
    tail_low = np.maximum(tail_low, first)
    bare_low, bare_high = np.concatenate([empty_low, tail_low]), np.concatenate([empty_high, last])
    bare = bare_low <= bare_high
    bare_low, bare_high = bare_low[bare], bare_high[bare]
    order = np.argsort(bare_low, kind="stable")
    return tick[held], low[held], high[held], bare_low[order], bare_high[order]


def blocks(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """(kind, trigger, first string, last string) of the blocks of strings in disjoint ascending ranges of ``data``."""
    h = rolling(data)
    rare, dense = np.flatnonzero(h % _U(RARE) == 0), np.flatnonzero(h % _U(DENSE) == 0)
    out = []
    for ticks, near, far in ((rare, NEAR, FAR), (dense, DENSE_NEAR, DENSE_FAR)):
        tick, low, high, first, last = _gaps(ticks, first, last)
        for kind, begin, end in ((near, np.maximum(low, tick - SPAN + 1), high), (far, low, np.minimum(high, tick - SPAN))):
            some = begin <= end
            out.append((np.full(int(some.sum()), kind), tick[some], begin[some], end[some]))
    alone = _chunks(first, last - first + 1)
    out.append((np.full(len(alone), BARE), alone, alone, alone))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


#: Of each kind, where the core begins and ends, from the trigger on.
CORES = {NEAR: (0, LENGTH - SPAN + 1), FAR: (-SPAN, GRAM), DENSE_NEAR: (0, LENGTH - SPAN + 1), DENSE_FAR: (-SPAN, GRAM), BARE: (0, LENGTH)}


def _pieces(starts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of a batch: (begin, end, document, first string, last string), at most about ``PIECE`` strings in each."""
    docs = np.flatnonzero(np.diff(starts) >= LENGTH)
    first, last = starts[docs], starts[docs + 1] - LENGTH
    split = (last - first) // PIECE + 1
    of = np.repeat(np.arange(len(docs)), split)
    part = _chunks(np.zeros(len(docs), np.int64), split)
    docs, first, last = docs[of], first[of] + part * PIECE, np.minimum(last[of], first[of] + (part + 1) * PIECE - 1)
    group = np.cumsum(last - first + 1) // PIECE
    edges = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(docs)]])
    for i, j in pairwise(edges):
        if i < j:
            yield int(first[i]), int(last[j - 1]) + LENGTH, docs[i:j], first[i:j], last[i:j]


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, and where each value begins, with the end."""
    whole = column.cast(pa.large_binary())
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), offsets


def _found(column: pa.Array):
    """(bytes, where documents begin, documents of the blocks, kinds, triggers, firsts, lasts) of each piece."""
    data, starts = _texts(column)
    for begin, end, docs, first, last in _pieces(starts):
        kind, tick, low, high = blocks(data[begin:end], first - begin, last - begin)
        owner = docs[np.searchsorted(first, low + begin, "right") - 1]
        yield data, starts, owner, kind, tick + begin, low + begin, high + begin


def _cores(data: memoryview, kind: np.ndarray, tick: np.ndarray) -> list[int]:
    ends = np.array([CORES.get(k, (0, 0)) for k in range(BARE + 1)])[kind]
    return [xxhash.xxh3_64_intdigest(data[a:b], k) for a, b, k in zip((tick + ends[:, 0]).tolist(), (tick + ends[:, 1]).tolist(), kind.tolist(), strict=True)]


def _alone(data: memoryview, owner: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of strings without a trigger: those to tell, once for a document, and which of all stand in their document twice."""
    seen: dict = {}
    first, again = np.zeros(len(low), bool), np.zeros(len(low), bool)
    for i, (doc, at) in enumerate(zip(owner.tolist(), low.tolist(), strict=True)):
        key = doc, xxhash.xxh3_128_digest(data[at : at + LENGTH])
        j = seen.setdefault(key, i)
        if i == j:
            first[i] = True
        else:
            again[i] = again[j] = True
    return first, again


def _runs(owner: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first, last) of runs of neighbouring places."""
    if not len(low):
        return owner, low, low
    cut = np.flatnonzero((np.diff(low) != 1) | (np.diff(owner) != 0)) + 1
    begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(low)]]) - 1
    return owner[begin], low[begin], low[end]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data, _, owner, kind, tick, low, _ in _found(batch.column(0)):
            view = memoryview(data)
            bare = kind == BARE
            first, again = _alone(view, owner[bare], low[bare])
            told = ~bare
            told[bare] = first
            keys = _cores(view, kind[told], tick[told])
            # What repeats within its document is to count as met.
            twice = np.flatnonzero(bare)[again & first]
            keys += _cores(view, kind[twice], tick[twice])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64), pa.int64())], names=["core"])


_BLOCK = "core long, whole long, id long, mark int, first long, n int, offset int, settled boolean"


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, marks = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
        for data, starts, owner, kind, tick, low, high in _found(batch.column(0)):
            view = memoryview(data)
            bare = kind == BARE
            first, again = _alone(view, owner[bare], low[bare])
            told = ~bare
            told[bare] = first
            run_owner, run_low, run_high = _runs(owner[bare][again], low[bare][again])
            cut = lambda x, last: np.concatenate([x[told], last])  # noqa: E731, B023
            owner, kind, tick, low, high = cut(owner, run_owner), cut(kind, np.full(len(run_low), BARE)), cut(tick, run_low), cut(low, run_low), cut(high, run_high)
            settled = np.arange(len(low)) >= told.sum()
            whole = [xxhash.xxh3_64_intdigest(view[a:b], 77) for a, b in zip(low.tolist(), np.where(settled, low + LENGTH, high + LENGTH).tolist(), strict=True)]
            columns = [
                pa.array(np.array(_cores(view, kind, tick), np.uint64).view(np.int64)), pa.array(np.array(whole, np.uint64).view(np.int64)), pa.array(ids[owner], pa.int64()), pa.array(marks[owner], pa.int32()),
                pa.array(low - starts[owner], pa.int64()), pa.array(high - low + 1, pa.int32()), pa.array(tick - low, pa.int32()), pa.array(settled),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _BLOCK.split(", ")])


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of a document's listed blocks."""
    for batch in batches:
        for text, doc_id, mark, listed in zip(batch.column(0), *(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            data = memoryview(text.as_buffer()) if text.is_valid else b""
            for i in range(0, len(listed), 4096):
                rows = listed[i : i + 4096]
                own = [bytes(data[r["first"] : r["first"] + r["n"] - 1 + LENGTH]) for r in rows]
                arrays = [pa.array([r["core"] for r in rows], pa.int64()), pa.array([doc_id] * len(rows), pa.int64()), pa.array([mark] * len(rows), pa.int32()), pa.array([r["first"] for r in rows], pa.int64()), pa.array([r["offset"] for r in rows], pa.int32()), pa.array([r["settled"] for r in rows]), pa.array(own, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["core", "id", "mark", "first", "offset", "settled", "text"])


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        half = (low + high) // 2
        low, high = (half, high) if a[low:half] == b[low:half] else (low, half)
    return low


def repeated_in_order(entries: list[tuple[int, bytes]]) -> list[list[int]]:
    """Of each block (place of the trigger, text) the strings that another place has too.

    The suffixes of the distinct phrases, up to the end of the trigger, are sorted, and so are
    the distinct continuations from the trigger on, with the common prefix of neighbours.
    Of strings that are equal to the end of the trigger, and so have it at one offset,
    neighbours in the order of continuations are equal if all prefixes between them reach
    the strings' end.
    """
    phrases = {text[: tick + GRAM] for tick, text in entries}
    suffixes = sorted({p[i:] for p in phrases for i in range(len(p) - GRAM + 1)})
    rank = {s: i for i, s in enumerate(suffixes)}
    ranks = {p: [rank[p[i:]] for i in range(len(p) - GRAM + 1)] for p in phrases}
    tails = sorted({text[tick:] for tick, text in entries})
    place = {t: i for i, t in enumerate(tails)}
    shared = [0, *(_common(a, b) for a, b in pairwise(tails))]
    in_order = sorted(range(len(entries)), key=lambda e: place[entries[e][1][entries[e][0] :]])
    out: list[list[int]] = [[] for _ in entries]
    most = max(tick for tick, _ in entries)
    for offset in range(most + 1):
        need, group, before = LENGTH - offset, 0, -1
        met: dict[tuple[int, int], list[int]] = defaultdict(list)
        for e in in_order:
            tick, text = entries[e]
            now = place[text[tick:]]
            if now != before:
                group += any(shared[x] < need for x in range(before + 1, now + 1))
                before = now
            at = tick - offset
            if 0 <= at <= len(text) - LENGTH:
                met[ranks[text[: tick + GRAM]][at], group].append(e)
        for own in met.values():
            if len(own) > 1:
                for e in own:
                    out[e].append(entries[e][0] - offset)
    return out


_STRINGS = "id long, mark int, first long, n int"


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated strings of the blocks of each core; its rows follow each other."""

    def told(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        for (doc_id, mark, first, _, settled, _), found in zip(rows, repeated_in_order([(r[3], r[5]) for r in rows]), strict=True):
            if not settled and found:
                _, low, high = _runs(np.zeros(len(found), np.int64), np.sort(np.array(found, np.int64)))
                out += [(doc_id, mark, first + a, b - a + 1) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int32()))], names=["id", "mark", "first", "n"])

    key, own = None, []
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("core", "id", "mark", "first", "offset", "settled", "text")]
        for core, *row in zip(*columns, strict=True):
            if core != key:
                if len(own) > 1:
                    yield told(own)
                key, own = core, []
            own.append(tuple(row))
    if len(own) > 1:
        yield told(own)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each string of blocks by its hash of 128 bits."""
    for batch in batches:
        for doc_id, mark, first, settled, text in zip(*(batch[c].to_pylist() for c in ("id", "mark", "first", "settled", "text")), strict=True):
            n = len(text) - LENGTH + 1
            keys = [xxhash.xxh3_128_digest(text[i : i + LENGTH]) for i in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([doc_id] * n, pa.int64()), pa.array([mark] * n, pa.int32()), pa.array(range(first, first + n), pa.int64()), pa.array([settled] * n)], names=["string", "id", "mark", "first", "settled"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, firsts, counts in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
            data = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
            low, high = covered(firsts, counts)
            kept, at = hashlib.sha256(), 0
            for a, b in zip(low.tolist(), high.tolist(), strict=True):
                kept.update(data[at:a])
                at = b
            kept.update(data[at:])
            out.append((len(data), int((high - low).sum()), len(low), kept.hexdigest(), low, high - low))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds))], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "span_starts", "span_lengths"])


def covered(firsts: pa.Scalar, counts: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of bytes, begin and end, that lists of repeated strings cover."""
    if not firsts.is_valid or not len(firsts.values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    low, n = firsts.values.to_numpy(), counts.values.to_numpy()
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate((low + n - 1 + LENGTH)[order])
    begins = np.concatenate([[True], low[1:] > high[:-1]])
    return low[begins], high[np.concatenate([begins[1:], [True]])]


def repeated_strings(docs: DataFrame, most: int = MOST) -> DataFrame:
    """(id, mark, first, n): runs of strings that repeat, of ``docs`` (id, mark, text as binary)."""
    cores = docs.select("text").mapInArrow(_counted, "core long").groupBy("core").agg(F.count("*").alias("times")).where("times > 1").select("core")
    met = docs.select("text", "id", "mark").mapInArrow(_described, _BLOCK).join(cores, "core")
    met = stored(met, "blocks")
    wholes = met.groupBy("core", "whole").agg(F.count("*").alias("times"), F.min_by(F.struct("id", "mark", "first", "n", "offset"), F.struct("id", "mark", "first")).alias("one"), F.bool_or("settled").alias("settled"))
    wholes = stored(wholes, "wholes")
    copies = met.join(wholes.where("times > 1").select("core", "whole"), ["core", "whole"], "left_semi")
    found = copies.where("not settled").union(met.where("settled")).select("id", "mark", "first", "n")

    contested = wholes.groupBy("core").agg(F.count("*").alias("blocks")).where("blocks > 1")
    asked = wholes.join(contested, "core").select("core", "blocks", "one.*", (F.col("settled") | (F.col("times") > 1)).alias("settled"))
    listed = asked.groupBy("id", "mark").agg(F.collect_list(F.struct("core", "first", "n", "offset", "settled")).alias("listed"))
    texts = docs.join(listed, ["id", "mark"]).select("text", "id", "mark", "listed")
    schema = "core long, id long, mark int, first long, offset int, settled boolean, text binary"
    texts = stored(texts.mapInArrow(_fetched, schema), "texts")
    crowded = contested.where(F.col("blocks") > most).select("core")
    few = texts.join(crowded, "core", "left_anti")
    ordered = few.repartition("core").sortWithinPartitions("core").mapInArrow(_ordered, _STRINGS)
    strings = texts.join(crowded, "core", "left_semi").mapInArrow(_strings, "string binary, id long, mark int, first long, settled boolean")
    twice = strings.groupBy("string").agg(F.count("*").alias("times")).where("times > 1").select("string")
    others = strings.where("not settled").join(twice, "string").select("id", "mark", "first", F.lit(1).alias("n"))
    return found.union(ordered).union(others)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256, span_starts, span_lengths), a row for each row of ``docs``.

    Each byte goes that a string of ``LENGTH`` bytes covers which starts elsewhere too, in
    another document or the same, overlapping or not; strings never cross documents and
    are judged on the input. The digest is of the bytes that stay, in lowercase hex.

    Nulls: a null text is empty; rows with a null id are documents like others. Texts are
    UTF-8 bytes and taken whole, in pieces where they are long; an empty one, or one
    shorter than a string, loses nothing. Repeated rows lose all strings, as each stands in
    the other; rows that share an id are told apart by a hash of 31 bits of their text.
    An empty table gives no rows; other columns are not read.
    """
    binary = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("own_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("id"), binary.alias("text"))
    rows = rows.withColumn("mark", F.abs(F.xxhash64("own_id", "text") % (2**31 - 1)).cast("int"))
    found = repeated_strings(rows.select("text", "id", "mark"), most)
    by_doc = found.groupBy("id", "mark").agg(F.collect_list(F.struct("first", "n")).alias("runs")).select("id", "mark", F.col("runs.first").alias("firsts"), F.col("runs.n").alias("counts"))
    joined = rows.join(by_doc, ["id", "mark"], "left").select("own_id", "text", "firsts", F.transform("counts", lambda x: x.cast("long")).alias("counts"))
    id_type = dict(docs.dtypes)[id_col]
    out = joined.mapInArrow(_cut, f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, span_starts array<long>, span_lengths array<long>")
    return out.withColumnRenamed("id", id_col)
