"""Text files, manifests and query results as units of input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.calendar import parsed_date
from recollect.functions.names import glob_match

QUERY_COLUMNS = ("unit_id", "time", "text", "speaker", "title")


def text_units(spark: SparkSession, path: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(path, activity, content, length, hash) of .txt and .md files under ``path``."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rel = F.regexp_replace(F.col("path"), r"^[a-z]+:/*", "/")
    units = read.where(F.lower("path").rlike(r"\.(txt|md)$"))
    for pattern in exclude:
        units = units.where(~glob_match(rel, pattern))
    return units.select("path", F.col("modificationTime").alias("activity"), "content", "length", F.sha2("content", 256).alias("hash"))


def increments(units: DataFrame, cursors: DataFrame) -> DataFrame:
    """(path, status, text, length, hash): what each unit has beyond its cursor (path, length, hash).

    A unit that still begins with what its cursor hashed is appended, or unchanged; any
    other change is rewritten and gives no text; without a cursor all of it is new.
    """
    old = cursors.select("path", F.col("length").alias("old_length"), F.col("hash").alias("old_hash"))
    joined = units.join(old, "path", "left")
    prefix = F.sha2(F.substring("content", F.lit(1), F.col("old_length").cast("int")), 256)
    same = (F.col("length") >= F.col("old_length")) & (prefix == F.col("old_hash"))
    status = F.when(F.col("old_length").isNull(), "new").when(~same, "rewritten").when(F.col("length") == F.col("old_length"), "unchanged").otherwise("appended")
    rest = F.substring("content", F.coalesce("old_length", F.lit(0)).cast("int") + 1, F.col("length").cast("int")).cast("string")
    return joined.withColumn("status", status).select("path", "status", F.when(F.col("status").isin("new", "appended"), rest).alias("text"), "length", "hash")


def settled(units: DataFrame, now: Column, hours: float = 3.0) -> DataFrame:
    """Units whose last activity is at least so many hours before ``now``."""
    return units.where(F.unix_micros(F.col("activity").cast("timestamp")) <= F.unix_micros(now.cast("timestamp")) - F.lit(int(hours * 3600e6)))


def query_units(spark: SparkSession, query: str) -> DataFrame:
    """An operator's own query as units: its columns are checked, then its rows.

    unit_id, time and text are required, speaker and title may follow, nothing else.
    unit_ids are unique and not empty, times are RFC 3339; a row that is not so
    raises when it is read.
    """
    rows = spark.sql(query)
    extra, missing = set(rows.columns) - set(QUERY_COLUMNS), set(QUERY_COLUMNS[:3]) - set(rows.columns)
    if extra or missing:
        raise ValueError(f"columns not allowed: {sorted(extra)}; missing: {sorted(missing)}")
    counts = rows.groupBy("unit_id").agg(F.count("*").alias("__n"))
    named = rows.join(counts, rows["unit_id"].eqNullSafe(counts["unit_id"])).drop(counts["unit_id"])
    time = F.col("time").cast("string")
    problem = F.when(F.coalesce(F.trim("unit_id"), F.lit("")) == "", "unit_id is empty").when(F.col("__n") > 1, "unit_id is not unique").when(parsed_date(time).isNull() | (F.length(time) == 10), "time is not RFC 3339")
    checked = F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(F.col("unit_id"))
    return named.withColumn("unit_id", checked).select(*rows.columns)


def manifest_units(spark: SparkSession, manifest: str) -> DataFrame:
    """The files that a JSON manifest's ``sources`` list, checked and ordered by date, undated first.

    A source whose sha256 differs from its file's raises when it is read.
    """
    shape = "sources array<struct<path:string,kind:string,title:string,date:string,home:string,external_id:string,sha256:string>>"
    listed = spark.read.schema(shape).option("multiLine", True).json(manifest).select(F.posexplode("sources").alias("n", "s")).select("n", "s.*")
    paths = [r["path"] for r in listed.select("path").distinct().toLocalIterator()]
    content = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content") if paths else spark.createDataFrame([], "path string, content binary")
    joined = listed.join(content, "path", "left")
    differs = F.col("sha256").isNotNull() & (F.sha2("content", 256) != F.col("sha256"))
    text = F.when(differs, F.raise_error(F.concat(F.lit("sha256 differs: "), F.col("path")))).otherwise(F.col("content").cast("string"))
    return joined.withColumn("text", text).drop("content").orderBy(F.col("date").asc_nulls_first(), "n").drop("n")
