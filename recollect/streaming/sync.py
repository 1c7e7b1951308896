"""Incremental import on Structured Streaming.

The stream reads units as they appear; a micro-batch appends what the log does not
have yet. The checkpoint remembers what was read, the keys in the log what was
appended, so a batch that is repeated after a failure appends nothing twice, and a
second run over the same input imports nothing. A batch's rows have a folder of their
own, named by the id that Spark keeps in the checkpoint and by the batch, so inputs with
checkpoints of their own, or a lost one, never overwrite each other's rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _log(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def first_of(units: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row by ``order`` of each key."""
    return units.groupBy(*keys).agg(F.min_by(F.struct(*units.columns), F.col(order)).alias("__r")).select("__r.*")


def append_new(batch: DataFrame, keys: list[str], order: str, path: str, query: str, batch_id: int) -> int:
    """Appends the first row by ``order`` of each new key to the log, in a folder for each query and batch; how many.

    A repeated batch overwrites its own folder, so it leaves what it left before.
    """
    spark = batch.sparkSession
    known = _log(spark, path, T.StructType([*batch.schema.fields, T.StructField("query", T.StringType()), T.StructField("batch", T.LongType())]))
    known = known.where((F.col("query") != query) | (F.col("batch") != batch_id)).select(*keys)
    own = f"{path}/query={query}/batch={batch_id}"
    first_of(batch, keys, order).join(known, keys, "left_anti").write.mode("overwrite").parquet(own)
    return spark.read.schema(batch.schema).parquet(own).count()


def query_of(spark: SparkSession, checkpoint: str) -> str:
    """The id of the query that a checkpoint belongs to; a new checkpoint has a new one."""
    return spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]


def sync(stream: DataFrame, keys: list[str], order: str, log: str, checkpoint: str) -> int:
    """Imports all that is there now; the number of rows it appended.

    Several inputs may share a log, each with its checkpoint, one at a time.
    """
    added = []

    def append(batch: DataFrame, batch_id: int) -> None:
        added.append(append_new(batch, keys, order, log, query_of(batch.sparkSession, checkpoint), batch_id))

    query = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(added)


def dry_run(units: DataFrame, keys: list[str], log: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """What an import would append, without writing anything: of each key the row that ``order`` puts first."""
    fresh = units.dropDuplicates(keys) if order is None else first_of(units, keys, order)
    return fresh if log is None else fresh.join(log.select(*keys), keys, "left_anti")


def deduplicated(stream: DataFrame, keys: list[str], time: str, delay: str = "3 hours") -> DataFrame:
    """A stream without repeats of a key that arrive within ``delay`` of each other."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def active_spans(events: DataFrame, unit: str, time: str, gap: str = "3 hours") -> DataFrame:
    """(unit, start, stop, n): stretches of activity with less than ``gap`` between events.

    Works on tables and on streams; on a stream a stretch comes out once the watermark
    has passed its end, and later events for it are dropped.
    """
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark(time, gap)
    spans = timed.groupBy(unit, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"), F.max(time).alias("last"))
    return spans.select(unit, F.col("w.start").alias("start"), F.col("last").alias("stop"), "n")


def settled_spans(spans: DataFrame, now: Column, hours: float = 3.0) -> DataFrame:
    """Stretches that ended at least so long before ``now``."""
    return spans.where(F.unix_micros("stop") <= F.unix_micros(now.cast("timestamp")) - F.lit(int(hours * 3600e6)))
