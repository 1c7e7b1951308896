"""The append-only log: keys, conflicts, and appending a batch exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.operators.tables import numbered

# Fixed values of the data contract.
ENTRY_KINDS = ("source", "note", "edit", "forget", "focus")
ACTORS = ("user", "agent", "system")


def dedup_key(kind: Column, text: Column, name: Column | None = None, session: Column | None = None, cursor: Column | None = None) -> Column:
    """SHA-256 of kind and text with a NUL between; synced increments add name, session and cursor."""
    parts = [kind, text, *(x for x in (name, session, cursor) if x is not None)]
    joined = parts[0]
    for part in parts[1:]:
        joined = F.concat(joined, F.lit("\x00"), F.coalesce(part, F.lit("")))
    return F.sha2(joined, 256)


def appended(log: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log's new rows and the batch's outcome.

    ``log`` has seq, kind, actor, created, payload and hash; ``batch`` the same without
    seq, and order, by which new rows are numbered on from the log's last. The outcome
    has order, seq, reused and conflict: a hash that the log, or an earlier row of the
    batch, has already is reused; with another payload it is a conflict and nothing is
    appended. Rows of unknown kind or actor are conflicts as well.
    """
    first = Window.partitionBy("hash").orderBy("order")
    told = batch.withColumn("lead", F.row_number().over(first) == 1).withColumn("lead_payload", F.first("payload").over(first))
    known = log.select("hash", F.col("seq").alias("old_seq"), F.col("payload").alias("old_payload"))
    joined = told.join(known, "hash", "left")
    legal = F.col("kind").isin(*ENTRY_KINDS) & F.col("actor").isin(*ACTORS)
    other = F.coalesce(F.col("old_payload"), F.col("lead_payload")) != F.col("payload")
    judged = joined.withColumn("conflict", ~F.coalesce(legal, F.lit(False)) | F.coalesce(other, F.lit(False)))
    fresh = judged.where("lead and old_seq is null and not conflict")
    # One row, so its join is with a constant.
    last = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last_seq"))
    placed = numbered(fresh, "n", "order").crossJoin(last).withColumn("seq", F.col("last_seq") + F.col("n"))
    rows = placed.select("seq", "kind", "actor", "created", "payload", "hash")
    places = judged.join(rows.select("hash", F.col("seq").alias("new_seq")), "hash", "left")
    reused = ~F.col("conflict") & (F.col("old_seq").isNotNull() | ~F.col("lead"))
    outcome = places.select("order", F.when(~F.col("conflict"), F.coalesce("old_seq", "new_seq")).alias("seq"), reused.alias("reused"), "conflict")
    return rows, outcome
