"""A Spark session with the settings this library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "recollect", **conf: str) -> SparkSession:
    """UTC and adaptive execution; further settings by name with dots as double underscores."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
