"""Cutting the lineage of tables that later steps read again and again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, the cluster's; where it is unset, as in tests, one is made."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors see")
        folder = "file://" + tempfile.mkdtemp(prefix="recollect-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """Writes ``df`` into the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/recollect-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``df`` with 1, 2, 3 and so on in ``name``, by ``order``, which should not tie.

    Ranges of the order are sorted in parallel; only their sizes are added up in one place.
    """
    ranged = kept(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.join(before, "__range").withColumn(name, F.col("__before") + place).drop("__range", "__before")
