import pytest

from recollect.streaming.progress import EditConflict, EntryFailed, wait_for

ATTEMPT = "seq long, attempt int, succeeded boolean, message string"


def test_waits_for_what_two_queries_do(spark, tmp_path):
    """Each query does some of the entries; one of them only after the wait has begun."""
    log = lambda: spark.range(1, 7).toDF("seq")
    attempts = lambda: spark.read.schema(ATTEMPT).parquet(str(tmp_path / "attempts"))
    spark.createDataFrame([], ATTEMPT).write.parquet(str(tmp_path / "attempts"))

    def start(name, rows):
        spark.createDataFrame(rows, ATTEMPT).write.parquet(str(tmp_path / name))
        stream = spark.readStream.schema(ATTEMPT).parquet(str(tmp_path / name))
        done = lambda batch, _: batch.write.mode("append").parquet(str(tmp_path / "attempts"))
        return stream.writeStream.foreachBatch(done).option("checkpointLocation", str(tmp_path / f"{name}-at")).start()

    queries = [start("a", [(1, 1, True, None), (3, 1, False, "no"), (3, 2, True, None)]), start("b", [(2, 1, True, None), *((4, n, False, "broken") for n in (1, 2, 3)), *((5, n, False, "edit conflict: o1") for n in (1, 2, 3))])]
    try:
        wait_for(spark, [1, 2, 3], log, attempts, 60)
        with pytest.raises(EntryFailed, match="entry 4 failed: broken"):
            wait_for(spark, [1, 4], log, attempts, 60)
        with pytest.raises(EditConflict, match="entry 5"):
            wait_for(spark, [5], log, attempts, 60)
        with pytest.raises(TimeoutError, match=r"\[6, 99\]"):
            wait_for(spark, [1, 6, 99], log, attempts, 0.1)
    finally:
        for query in queries:
            query.stop()
