"""Days that close once, late rows kept aside, and days that open again when they are forgotten.

The log's order is that of arrival, so the watermark runs over the time of arrival and a
row's day over the time that it tells of: no row is late for the stream, however old its
day. A day closes when the watermark has passed its end. What arrives for a closed day
waits; forgetting the day opens it, and its next build has everything that waited. The
state of a day is a number and a flag, whatever the number of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

TOLD = "day string, id string, version long, late boolean"
_DAY_MILLIS = 86_400_000


class DayGate(StatefulProcessor):
    """Rows (day, id, created, forgets) of one day to the version of its builds that each belongs to.

    A row that is null in id tells that a build is due.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.day = handle.getValueState("day", "builds long, closed boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        builds, closed = self.day.get() if self.day.exists() else (0, False)
        known, forgotten = self.day.exists(), False
        for batch in rows:
            forgotten |= bool(batch["forgets"].any())
            ids = batch.loc[~batch["forgets"], "id"]
            if len(ids):
                known = True
                yield pd.DataFrame({"day": key[0], "id": ids.to_numpy(), "version": builds + 1, "late": closed})
        # Forgetting a day of which nothing is known has no effect.
        if not known:
            return
        due = not closed or forgotten
        self.day.update((builds, not due))
        if due and not any(True for _ in self.handle.listTimers()):
            end = int(pd.Timestamp(key[0], tz="UTC").value // 1_000_000) + _DAY_MILLIS
            self.handle.registerTimer(max(end, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        builds = self.day.get()[0] + 1
        self.day.update((builds, True))
        yield pd.DataFrame({"day": [key[0]], "id": [None], "version": [builds], "late": [False]})

    def close(self) -> None:
        pass


def day_versions(rows: DataFrame, forgets: DataFrame | None = None, delay: str = "3 hours") -> DataFrame:
    """A stream (day, id, version, late) of the rows (id, day, created) of a log, and of builds, null in id.

    A row belongs to the builds of its day from ``version`` on; ``late`` says that the day was
    closed when it came. ``forgets`` (day, created) is a stream that opens days again. A
    day's rows of one micro-batch go through one task, which holds none of them; rows
    whose day is no date are left out. ``created`` must not run back by more than ``delay``
    against what came before, since Spark drops such rows. Start inside ``cursors.state_store``.
    """
    day = F.date_format(F.col("day").try_cast("date"), "yyyy-MM-dd").alias("day")
    told = rows.select(day, F.col("id").cast("string").alias("id"), F.col("created").cast("timestamp").alias("created"), F.lit(False).alias("forgets"))
    if forgets is not None:
        told = told.union(forgets.select(day, F.lit(None).cast("string"), F.col("created").cast("timestamp"), F.lit(True)))
    keyed = told.where("day is not null").withWatermark("created", delay).groupBy("day")
    return keyed.transformWithStateInPandas(DayGate(), outputStructType=TOLD, outputMode="Append", timeMode="EventTime")


def built(told: DataFrame) -> DataFrame:
    """(day, id, version): the rows that each day's last build has, of what ``day_versions`` told; version is that build's."""
    last = told.where("id is null").groupBy("day").agg(F.max("version").alias("last"))
    return told.where("id is not null").join(last, "day").where("version <= last").select("day", "id", F.col("last").alias("version"))


def waiting(told: DataFrame) -> DataFrame:
    """(day, id): late rows that no build of their day has yet."""
    return told.where("late").join(built(told).select("day", "id"), ["day", "id"], "left_anti").select("day", "id")
