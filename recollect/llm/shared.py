"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by the contracts: a word is a run of characters outside this set.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    ``spark.checkpoint.dir`` names it; only where that is unset (tests on one
    machine) a folder of our own is made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors see")
        folder = "file://" + tempfile.mkdtemp(prefix="recollect-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back.

    This cuts the lineage as checkpoint() does, but columnar and compressed, so
    a lost executor costs no more than the tasks that ran on it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/recollect-{uuid.uuid4().hex[:12]}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fingerprint(df: DataFrame, *cols: str) -> tuple:
    """Count and order-free hash of the rows, to tell whether two tables agree."""
    return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64(*cols))).first())


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    """The C library's call that gives unused memory back; one that does nothing where there is none."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return lambda _: 0


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over batches, with memory that is no longer used given back after each batch and at the end.

    A worker serves one stage after the other, and what Arrow and the C library keep for
    reuse counts beside all that the later stages need.
    """

    @wraps(run)
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for out in run(batches):
                yield out
                del out
                pa.default_memory_pool().release_unused()
        finally:
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return over
