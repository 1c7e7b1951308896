"""Spelling variants: words one edit apart, by composing finite automata.

The words of a corpus, counted, are the vocabulary. Two of them are near if exactly one
inserted, deleted or replaced code point turns one into the other. A partition of the
vocabulary becomes a minimised acyclic acceptor; composed with the transducer of one edit
and with itself once more, its accepted pairs are the near words.

Before the edit both copies of a deterministic acceptor have read the same letters and
stand in one state, so a state of the composition is one state, or, after the edit, a pair
of them whose languages have to meet. What follows a state is composed once, however many
prefixes lead there, and only states from which some pair is accepted are walked through.

Scale: the vocabulary is never in one place. A pair whose shorter word has ``base`` code
points differs either after the first half of them, and then both words begin alike, or
before, and then they end alike. So the initial states that the first half leads to (and,
backwards, the second half) part the work, and of each word four rows are sent. Partitions
of more than ``MOST`` words are parted again by half of what lies between, until they are
small or a single letter is left between, where the alphabet bounds them. The place of the
edit decides which partition tells of a pair, so none is told twice.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.shared import stored

#: Fixed by the contract: letters, the least code points and occurrences of a word, how many times a form is as frequent.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: Every so many runs, by CRC-32, lose a letter.
DROP = 199
#: Words of a partition in one task, rows of a task, words counted before they are sent on, code points of a text read as a list.
MOST, ROWS, HELD, WHOLE = 20_000, 10_000, 400_000, 1 << 22


def damaged(doc_id: int | None, run: str) -> str:
    """The run, less one code point where its CRC-32 with the document's id says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % DROP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter[str] = Counter()

    def told() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
        total.clear()
        return out

    for batch in batches:
        for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
            # Of bytes only A-Z are lowered.
            text = (value.as_py() or b"").lower().decode("utf-8", "replace")
            runs = RUN.findall(text) if len(text) <= WHOLE else (m[0] for m in RUN.finditer(text))
            for run, n in Counter(runs).items():
                word = damaged(doc_id, run)
                if len(word) >= LEAST_LENGTH:
                    total[word] += n
            if len(total) >= HELD:
                yield told()
    yield told()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words long and frequent enough."""
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_counted, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Acceptor:
    """The minimised acyclic acceptor of distinct sorted words; state 0 accepts only the end."""

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, int]] = [{}]
        self.final = [True]
        self._known: dict[tuple, int] = {(True,): 0}
        # The path of the last word: of each place its edges so far and whether a word ends there.
        path: list[tuple[dict[str, int], bool]] = [({}, False)]
        last = ""
        for word in words:
            shared = next((i for i, (x, y) in enumerate(zip(last, word, strict=False)) if x != y), min(len(last), len(word)))
            self._close(path, last, shared)
            path += [({}, False) for _ in range(len(word) - shared)]
            path[-1] = (path[-1][0], True)
            last = word
        self._close(path, last, 0)
        self.start = self._state(*path[0])

    def _close(self, path: list, word: str, depth: int) -> None:
        """Ends the places of ``path`` beyond ``depth``; states of equal continuation are one."""
        while len(path) - 1 > depth:
            state = self._state(*path.pop())
            path[-1][0][word[len(path) - 1]] = state

    def _state(self, edges: dict[str, int], final: bool) -> int:
        key = (final, *edges.items())
        if key not in self._known:
            self._known[key] = len(self.edges)
            self.edges.append(edges)
            self.final.append(final)
        return self._known[key]


class Composition:
    """acceptor o one edit o acceptor: each pair (x, y) of accepted words one edit apart once.

    In a pair x has the smaller letter at the edit, or the letter that y lacks. A letter
    dropped from a run of equal ones counts as the run's last, so the edit's place is
    the length of the common prefix.
    """

    def __init__(self, words: list[str]):
        self.acceptor = Acceptor(words)
        self._meets: dict[tuple[int, int], bool] = {}
        self._edits: dict[int, list[tuple[str, str, int, int]]] = {}
        self._productive = self._trimmed()

    def _meet(self, p: int, q: int) -> bool:
        """Whether some word continues both states."""
        edges, final, known = self.acceptor.edges, self.acceptor.final, self._meets
        todo = [(p, q)]
        while todo:
            a, b = pair = todo[-1]
            if pair in known:
                todo.pop()
            elif a == b or final[a] and final[b]:
                known[pair] = True
            else:
                after = [(edges[a][c], edges[b][c]) for c in edges[a] if c in edges[b]]
                open_ = next((x for x in after if x not in known), None)
                if any(known.get(x) for x in after) or open_ is None:
                    known[pair] = any(known.get(x) for x in after)
                else:
                    todo.append(open_)
        return known[p, q]

    def _continued(self, p: int, q: int, barred: str) -> bool:
        """Whether a word continues both states that does not begin with the letter ``barred``."""
        edges, final = self.acceptor.edges, self.acceptor.final
        return final[p] and final[q] or any(c != barred and c in edges[q] and self._meet(edges[p][c], edges[q][c]) for c in edges[p])

    def edits(self, state: int) -> list[tuple[str, str, int, int]]:
        """The edits in a state that lead on: (letter of x, letter of y or none, state of x, state of y)."""
        if state not in self._edits:
            out = sorted(self.acceptor.edges[state].items())
            found = [(c, d, p, q) for i, (c, p) in enumerate(out) for d, q in out[i + 1 :] if self._meet(p, q)]
            found += [(c, "", p, state) for c, p in out if self._continued(p, state, c)]
            self._edits[state] = found
        return self._edits[state]

    def _trimmed(self) -> list[bool]:
        """Of each state whether an edit is possible in it or later; states come after those they lead to."""
        found: list[bool] = []
        for state, out in enumerate(self.acceptor.edges):
            found.append(any(found[t] for t in out.values()) or bool(self.edits(state)))
        return found

    def pairs(self, upto: int | None = None) -> Iterator[tuple[str, str]]:
        """Accepted pairs whose common prefix is shorter than ``upto``."""
        edges = self.acceptor.edges
        todo: list[tuple[int, tuple | None, int]] = [(self.acceptor.start, None, 0)]
        while todo:
            state, path, depth = todo.pop()
            if not self._productive[state] or upto is not None and depth >= upto:
                continue
            for c, d, p, q in self.edits(state):
                head = _letters(path)
                for tail in self._common(p, q, c if not d else ""):
                    yield head + c + tail, head + d + tail
            todo += [(t, (path, c), depth + 1) for c, t in edges[state].items()]

    def _common(self, p: int, q: int, barred: str) -> Iterator[str]:
        edges, final = self.acceptor.edges, self.acceptor.final
        todo: list[tuple[int, int, tuple | None]] = [(p, q, None)]
        while todo:
            a, b, path = todo.pop()
            if final[a] and final[b]:
                yield _letters(path)
            for c, t in edges[a].items():
                if c in edges[b] and (path is not None or c != barred) and self._meet(t, edges[b][c]):
                    todo.append((t, edges[b][c], (path, c)))


def _letters(path: tuple | None) -> str:
    out = []
    while path is not None:
        path, letter = path
        out.append(letter)
    return "".join(reversed(out))


_NODE = ["base", "a", "b", "head", "tail"]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both directions of the pairs of each partition; its rows follow each other."""

    def told(key: tuple, words: dict[str, int]) -> pa.RecordBatch:
        base, a, b, *_, limit = key
        whole = {w[a : len(w) - b]: w for w in words}
        # Two words longer than base belong to the partitions of the next base.
        found = Composition(sorted(whole)).pairs(None if limit is None else limit - a)
        out = [(whole[x], whole[y]) for x, y in found if len(y) == base - a - b]
        out += [(y, x) for x, y in out]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.string()), pa.array([words[y] for _, y in out], pa.int64())], names=["word", "near", "near_n"])

    key, words = None, {}
    for batch in batches:
        for *node, limit, word, n in zip(*(batch[c].to_pylist() for c in [*_NODE, "upto", "word", "n"]), strict=True):
            if (now := (*node, limit)) != key:
                if len(words) > 1:
                    yield told(key, words)
                key, words = now, {}
            words[word] = n
    if len(words) > 1:
        yield told(key, words)


def _parted(rows: DataFrame) -> DataFrame:
    """Each row of a partition in its two halves: alike in the first half of what lies between, or in the second."""
    half = F.floor((F.col("base") - F.col("a") - F.col("b")) / 2).cast("int")
    between = F.col("base") - F.col("a") - F.col("b")
    first = F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b"), F.col("upto").alias("upto"))
    second = F.struct(F.col("a").alias("a"), (F.col("b") + between - half).alias("b"), (F.col("a") + half).alias("upto"))
    out = rows.select("word", "n", "base", F.explode(F.array(first, second)).alias("x")).select("word", "n", "base", "x.a", "x.b", "x.upto")
    ends = F.expr("if(b = 0, '', right(word, b))")
    return out.withColumns({"head": F.expr("left(word, a)"), "tail": ends})


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, near, near_n): both directions of all pairs of ``words`` (word, n) one edit apart."""
    size = F.length("word")
    whole = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("base")).where("base > 0")
    rows = _parted(whole.withColumns({"a": F.lit(0), "b": F.lit(0), "upto": F.lit(None).cast("int")}))
    found = None
    while True:
        sizes = rows.groupBy(*_NODE).agg(F.count("*").alias("size"), F.min(F.length("word")).alias("least")).where("size > 1 and least = base").drop("least")
        # The letters between bound what can't be parted any more.
        rows = stored(rows.join(sizes, _NODE), "partitions")
        large = (F.col("size") > most) & (F.col("base") - F.col("a") - F.col("b") > 1)
        # Few bytes, but much work: the tasks are counted by rows, and one for each core at least.
        tasks = max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // ROWS)
        small = rows.where(~large).repartition(tasks, *_NODE).sortWithinPartitions(*_NODE).select(*_NODE, "upto", "word", "n").mapInArrow(_near, "word string, near string, near_n long")
        found = small if found is None else found.union(small)
        rest = rows.where(large).drop("size")
        if rest.isEmpty():
            return found
        rows = _parted(rest)


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """(word, form, root, n, n_near, form_n), a row for each word of the vocabulary.

    A word's form is its most frequent near word, if that is ``TIMES`` times as frequent;
    of equally frequent ones the smallest in code-point order. Its root is where following
    forms ends, at itself where it has none. As n grows along forms, there are no rings.

    Nulls and empty texts have no words; a null id counts as an empty one. Very long texts
    and words are taken whole. Repeated rows count as often as they stand there; an empty
    table gives no rows; other columns are not read.
    """
    words = stored(vocabulary(docs, id_col, text_col), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("word")))
    near = near_words(words, most).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left").withColumn("best_n", -F.col("best.less"))
    fits = F.col("best_n") >= TIMES * F.col("n")
    rows = stored(joined.select("word", F.when(fits, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best_n")).alias("form_n")), "forms")
    ends = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        # Twice as far in each round: where a root has a root of its own, that is taken.
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ends = stored(ends.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if ends.where("moved").isEmpty():
            break
        ends = ends.drop("moved")
    return rows.join(ends.drop("moved"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
