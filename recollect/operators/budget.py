"""Packing ranked rows into token budgets.

These are sequential by nature: whether a row fits depends on all before it. Each
group's rows stream in order past a few numbers of state, so groups are independent and
one may be of any length.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _streamed(df: DataFrame, group: list[str], order: list[Column], size: str, name: str, start: Callable[[], Callable[[int], int | None]]) -> DataFrame:
    """``df`` with ``name``: what the function that ``start`` makes for each group says of its rows' sizes, in order.

    A null size counts as nothing.
    """
    rows = df.select(*group, *(c for c in df.columns if c not in group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, say = None, None
        for batch in batches:
            out = []
            for now, n in zip(zip(*(batch[c].to_pylist() for c in group), strict=True), batch["__size"].to_pylist(), strict=True):
                if say is None or now != key:
                    key, say = now, start()
                out.append(say(n or 0))
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.int64())], names=[*batch.schema.names[:-1], name])

    dealt = rows.withColumn("__size", F.col(size).cast("long")).repartition(*group).sortWithinPartitions(*group, *order)
    return dealt.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.LongType())]))


def windows(df: DataFrame, group: list[str], order: list[Column], size: str, limit: int) -> DataFrame:
    """``df`` with window: rows in order fill windows of ``limit``; one that does not fit opens the next.

    A row larger than the limit has a window of its own. Windows count from 0.
    """

    def start() -> Callable[[int], int]:
        number = used = 0

        def say(n: int) -> int:
            nonlocal number, used
            if used > 0 and used + n > limit:
                number, used = number + 1, n
            else:
                used += n
            return number

        return say

    return _streamed(df, group, order, size, "window", start)


def first_fit(df: DataFrame, group: list[str], order: list[Column], size: str, budget: int) -> DataFrame:
    """``df`` with used: the tokens used once the row was added, null where it did not fit.

    A row that does not fit is skipped and later ones still tried.
    """

    def start() -> Callable[[int], int | None]:
        used = 0

        def say(n: int) -> int | None:
            nonlocal used
            if used + n > budget:
                return None
            used += n
            return used

        return say

    return _streamed(df, group, order, size, "used", start)


# Shares of a brief's budget, the decay of a page's further lines, the
# exponent of affinity, and how many omitted ids are named.
SPINE_SHARE, DIRECTORY_SHARE, DECAY, AFFINITY_EXPONENT, NEXT_CAP = 0.3, 0.25, 0.95, 4, 8


def estimate(text: str) -> int:
    return (4 * len(text.split()) + 2) // 3


@dataclass
class Page:
    """A page of a brief with its ranked lines (id, rank, text), best first."""

    slug: str
    heading: str
    lines: list[tuple[str, float, str]]
    parent: str | None = None
    affinity: float | None = None


@dataclass
class Brief:
    text: str = ""
    tokens: int = 0
    shown: list[str] = field(default_factory=list)
    next: list[str] = field(default_factory=list)
    truncated: bool = False


class Assembly:
    """Greedy choice of lines by rank under a budget.

    Repeatedly the line of the highest rank, decayed by the lines its page already has,
    that fits is taken. A page's first line opens its heading; headings may use
    ``SPINE_SHARE`` of the budget, the first one more. With affinities a page may use
    its share of their fourth powers, ``total`` being the sum of those. Pages go by
    their place in page order.
    """

    def __init__(self, budget: int, title: str, decay: float = DECAY, hidden: set[str] | None = None, total: float = 0.0):
        self.budget, self.title, self.decay, self.total = budget, title, decay, total
        self.spine = self.spent = estimate(title)
        self.closed = False
        self.pages: dict[int, Page] = {}
        self.chosen: dict[int, list[tuple[str, str]]] = {}
        self.used: dict[int, int] = {}
        self.shown: set[str] = set(hidden or ())

    def _cost(self, row: tuple, limit: int, main: int, new_pages: bool) -> int | None:
        """What the heading takes; None where the row does not fit, and so won't later in this filling."""
        _, i, _, oid, _, size, page = row
        if oid in self.shown:
            return None
        cost = 0
        if i not in self.chosen:
            cost = estimate("\n##" + page.heading)
            if not new_pages or (self.chosen and self.spine + cost > int(main * SPINE_SHARE)):
                return None
        if self.spent + cost + size > limit:
            return None
        if page.affinity is not None and self.total > 0 and self.used.get(i, 0) + size > main * page.affinity**AFFINITY_EXPONENT / self.total:
            return None
        return cost

    def fill(self, rows: Iterable[tuple], limit: int, main: int, new_pages: bool = True, least: int = 1, least_heading: int = 1) -> None:
        """Takes lines of ``rows`` (rank, page's place, line's place, id, text, tokens, page), sorted by
        the first three, highest rank first, and read only as far as needed.

        A row not read yet is worth no more than the last one read, so the best row that
        waits is taken once it is worth that. ``least`` and ``least_heading`` are the
        tokens of the shortest line and heading; ``closed`` says that no page can be
        opened any more, so that a source need not give lines of other pages.
        """
        waiting: dict[int, deque] = {}
        rows, bound = iter(rows), float("inf")
        while self.spent + least <= limit:
            self.closed = not new_pages or bool(self.chosen) and self.spine + least_heading > int(main * SPINE_SHARE)
            best = None
            for i in list(waiting):
                while waiting[i] and (cost := self._cost(waiting[i][0], limit, main, new_pages)) is None:
                    waiting[i].popleft()
                if not waiting[i]:
                    del waiting[i]
                    continue
                row = waiting[i][0]
                key = (-self._value(row), -row[0], row[1], row[2])
                if best is None or key < best[0]:
                    best = (key, cost, row)
            worth = float("-inf") if best is None else -best[0][0]
            if best is not None and worth >= bound:
                _, cost, (_, i, _, oid, text, size, page) = best
                waiting[i].popleft()
                self.spine += cost
                self.spent += cost + size
                self.pages[i] = page
                self.chosen.setdefault(i, []).append((oid, text))
                self.used[i] = self.used.get(i, 0) + size
                self.shown.add(oid)
                continue
            if best is None and bound == float("-inf"):
                return
            while bound > worth:
                row = next(rows, None)
                if row is None:
                    bound = float("-inf")
                    break
                # A negative rank grows when it decays.
                bound = max(row[0], 0.0)
                if self._cost(row, limit, main, new_pages) is not None:
                    waiting.setdefault(row[1], deque()).append(row)
                    worth = max(worth, self._value(row))

    def _value(self, row: tuple) -> float:
        return row[0] * self.decay ** len(self.chosen.get(row[1], ()))

    def render(self, tail: str, parents: dict[str, str | None], left: list[str], n_pages: int) -> Brief:
        """Pages in page order under their nearest shown ancestor, at most six levels deep.

        ``left`` are the best ids that are not shown, ``n_pages`` the pages that hold lines.
        """
        shown = {self.pages[i].slug for i in self.chosen}
        below: dict[str | None, list[int]] = {}
        for i in sorted(self.chosen):
            up, seen = parents.get(self.pages[i].slug), set()
            while up is not None and up not in shown and up not in seen:
                seen.add(up)
                up = parents.get(up)
            below.setdefault(up if up in shown else None, []).append(i)
        out = Brief()

        def add(text: str) -> None:
            if out.tokens + estimate(text) <= self.budget:
                out.text += text
                out.tokens += estimate(text)

        def emit(over: str | None, depth: int) -> None:
            for i in below.get(over, ()):
                add("\n" + "#" * min(6, depth + 2) + " " + self.pages[i].heading + "\n")
                for oid, text in self.chosen[i]:
                    add(text + "\n")
                    out.shown.append(oid)
                emit(self.pages[i].slug, depth + 1)

        add(self.title)
        emit(None, 0)
        add(tail)
        out.next = left[:NEXT_CAP]
        out.truncated = bool(left) or len(self.chosen) < n_pages
        return out


def assemble(pages: list[Page], budget: int, title: str, decay: float = DECAY, directory=None, hidden: set[str] | None = None) -> Brief:
    """A brief; ``directory`` (covered ids, budget) -> text takes up to its share of the budget.

    What the directory leaves goes to more lines on pages that are already open.
    """
    reserve = int(budget * DIRECTORY_SHARE) if directory else 0
    total = sum((p.affinity or 0.0) ** AFFINITY_EXPONENT for p in pages if p.affinity is not None)
    work = Assembly(budget, title, decay, hidden, total)
    rows = sorted(((rank, i, k, oid, text, estimate(text), p) for i, p in enumerate(pages) for k, (oid, rank, text) in enumerate(p.lines)), key=lambda r: (-r[0], r[1], r[2]))
    work.fill(rows, budget - reserve, budget - reserve)
    tail = directory({oid for i in work.chosen for oid, _, _ in pages[i].lines}, reserve) if directory else ""
    work.fill(rows, budget - estimate(tail), budget - reserve, new_pages=False)
    left = list(dict.fromkeys(r[3] for r in rows if r[3] not in work.shown))
    return work.render(tail, {p.slug: p.parent for p in pages}, left, len(pages))
