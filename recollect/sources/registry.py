"""Which reader a source's name stands for, and what of its units a run imports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators.tables import numbered
from recollect.sources import files, sessions

#: (spark, path) -> units, by the name that a configuration gives.
ADAPTERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "files": files.text_units,
    "manifest": files.manifest_units,
    "query": files.query_units,
    **{name: lambda spark, path, n=name: sessions.sessions(sessions.json_lines(spark, path), n) for name in sessions.FORMATS},
}


def adapter(name: str) -> Callable[[SparkSession, str], DataFrame]:
    if name not in ADAPTERS:
        raise ValueError(f"no source named {name}; there are {', '.join(sorted(ADAPTERS))}")
    return ADAPTERS[name]


def since_cutoff(units: DataFrame, time: str, cutoff: Column | None) -> DataFrame:
    """Units, or messages, from the cutoff on; those without a time lie before any cutoff.

    Works on tables and on streams, where it belongs before the watermark.
    """
    return units if cutoff is None else units.where(F.col(time).cast("timestamp") >= cutoff)


def new_messages(messages: DataFrame, known: DataFrame, cutoff: Column | None = None) -> DataFrame:
    """Messages (session, id, role, timestamp) not yet ``known`` (session, id) and not before the cutoff.

    A session without a new message of its user has nothing to import yet.
    """
    fresh = since_cutoff(messages, "timestamp", cutoff).join(known.select("session", "id"), ["session", "id"], "left_anti")
    return fresh.join(fresh.where("role = 'user'").select("session").distinct(), "session", "left_semi")


def pending_order(units: DataFrame, found: str) -> DataFrame:
    """``units`` with order, in which they are appended: by happened, then as they were ``found``."""
    return numbered(units, "order", F.asc("happened"), F.asc(found))


def sync_counts(decisions: DataFrame) -> DataFrame:
    """(units, submitted, skipped, messages) of decisions (unit, home, messages, reused).

    Units without a home, or without new messages, are skipped; submitted are those that
    the log did not have yet.
    """
    taken = F.col("home").isNotNull() & (F.coalesce("messages", F.lit(0)) > 0)
    return decisions.agg(
        F.count("*").alias("units"),
        F.count_if(taken & ~F.coalesce("reused", F.lit(False))).alias("submitted"),
        F.count_if(~taken).alias("skipped"),
        F.coalesce(F.sum(F.when(taken, F.col("messages"))), F.lit(0)).cast("long").alias("messages"),
    )
