"""Tables of a state that moves on with a log: each step writes what it changed, then a manifest that names it.

A table is a list of segments; the manifest has as many rows as its versions have segments,
which merging bounds, and is read whole. A step adds some for what the log's new entries changed and
publishes the list with the sequence number that it reaches; readers take the newest
version, so a step that fails, or one that is made again, leaves no trace. A rebuild begins
an empty list beside the present one, and is switched to by the same act. Segments beyond
``MOST`` are merged by the caller, who knows which row of a key counts.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "version long, seq long, table string, segment string"
#: Segments of a table up to which a step just adds one.
MOST = 16


@dataclass
class Snapshot:
    """The sequence number that the tables reach, and their segments."""

    seq: int = 0
    version: int = 0
    tables: dict[str, list[str]] = field(default_factory=dict)


class Snapshots:
    """One writer at a time, any number of readers, in a folder that the driver and all executors see."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def newest(self) -> Snapshot:
        """The last published version; an empty one where there is none."""
        try:
            told = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return Snapshot()
        told = told.collect()
        last = max((r["version"] for r in told), default=0)
        rows = [r for r in told if r["version"] == last]
        out = Snapshot()
        for r in rows:
            out.seq, out.version = r["seq"], r["version"]
            if r["segment"] is not None:
                out.tables.setdefault(r["table"], []).append(r["segment"])
        return out

    def read(self, at: Snapshot, table: str, schema: str) -> DataFrame:
        own = at.tables.get(table, [])
        if not own:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{table}/{s}" for s in own))

    def advance(self, at: Snapshot, seq: int, added: dict[str, DataFrame], replaced: dict[str, DataFrame] | None = None) -> Snapshot:
        """Publishes ``at`` with the rows of ``added``, and with ``replaced`` in place of whole tables, as of ``seq``."""
        tables = {name: list(own) for name, own in at.tables.items() if name not in (replaced or {})}
        for name, df in [*added.items(), *(replaced or {}).items()]:
            segment = uuid.uuid4().hex
            path = f"{self.path}/{name}/{segment}"
            df.write.parquet(path)
            tables.setdefault(name, []).append(segment)
        # A rebuild's version follows the present one too.
        version = (at.version or self.newest().version) + 1
        rows = [(version, seq, name, s) for name, own in tables.items() for s in own] or [(version, seq, None, None)]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return Snapshot(seq, version, tables)
