"""Waiting until given entries of a log are done, while queries work on them."""

from __future__ import annotations

import time
from collections.abc import Callable
from threading import Event

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from recollect.operators.fold import entry_status

#: How the message of an entry begins that lost against a later change: a fixed value of the data contract.
CONFLICT = "edit conflict:"


class EntryFailed(ValueError):
    """An entry ended in an error."""


class EditConflict(EntryFailed):
    """An entry's edit lost against a later change of its target."""


class _Moves(StreamingQueryListener):
    def __init__(self):
        self.moved = Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.moved.set()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.moved.set()


def wait_for(spark: SparkSession, seqs: list[int], log: Callable[[], DataFrame], attempts: Callable[[], DataFrame], timeout: float, poll: float = 5.0) -> None:
    """Returns once all of ``seqs`` are done, whichever query does them.

    ``log`` and ``attempts`` read the tables anew, shaped as ``fold.entry_status`` takes
    them. They are read when a query reports progress or ends, and every ``poll`` seconds,
    since tables may move without one; only the rows of ``seqs`` come to the driver. Raises
    EditConflict or EntryFailed for the first of them that ended in an error, and
    TimeoutError where some are unfinished after ``timeout`` seconds, or are not in the log.
    """
    asked = spark.createDataFrame([(s,) for s in set(seqs)], "seq long")
    listener, end = _Moves(), time.monotonic() + timeout
    spark.streams.addListener(listener)
    try:
        while True:
            listener.moved.clear()
            tries = attempts().join(F.broadcast(asked), "seq", "left_semi")
            told = entry_status(log().join(F.broadcast(asked), "seq", "left_semi"), tries).collect()
            for r in sorted(told, key=lambda r: r["seq"]):
                if r["error"] is not None:
                    kind = EditConflict if r["error"].startswith(CONFLICT) else EntryFailed
                    raise kind(f"entry {r['seq']} failed: {r['error']}")
            open_ = set(seqs) - {r["seq"] for r in told if r["status"] == "done"}
            if not open_:
                return
            left = end - time.monotonic()
            if left <= 0:
                raise TimeoutError(f"unfinished: {sorted(open_)[:10]}")
            listener.moved.wait(min(left, poll))
    finally:
        spark.streams.removeListener(listener)
