from recollect.streaming import cursors
from recollect.streaming.periods import built, day_versions, waiting

ROW = "id string, day string, created timestamp"
FORGET = "day string, created timestamp"


def test_a_closed_day_stays_as_it_is_until_it_is_forgotten(spark, tmp_path):
    """Three runs of one stream: a day closes, a late row waits, forgetting the day lets it in."""
    for name in ("rows", "forgets"):
        (tmp_path / name).mkdir()

    def add(name, rows, schema):
        spark.createDataFrame(rows, "id string, day string, created string" if schema is ROW else "day string, created string").selectExpr(*(f"cast({x.split()[0]} as {x.split()[1]})" for x in schema.split(", "))).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def run():
        rows = spark.readStream.schema(ROW).parquet(str(tmp_path / "rows"))
        forgets = spark.readStream.schema(FORGET).parquet(str(tmp_path / "forgets"))
        with cursors.state_store(spark, 2):
            query = day_versions(rows, forgets).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
            query.awaitTermination()
        told = spark.read.parquet(str(tmp_path / "out"))
        return sorted(map(tuple, built(told).collect())), sorted(map(tuple, waiting(told).collect()))

    add("rows", [("a", "2024-01-01", "2024-01-01 10:00:00"), ("b", "2024-01-01", "2024-01-01 11:00:00"), ("x", "no day", "2024-01-01 11:00:00"), ("c", "2024-01-02", "2024-01-02 04:00:00")], ROW)
    add("forgets", [("2023-05-05", "2024-01-01 10:00:00")], FORGET)
    first = [("2024-01-01", "a", 1), ("2024-01-01", "b", 1)]
    assert run() == (first, [])
    # One comes too late for the first day; the second, forgotten while it is open, just goes on.
    add("rows", [("d", "2024-01-01", "2024-01-02 05:00:00"), ("e", "2024-01-02", "2024-01-02 06:00:00")], ROW)
    add("forgets", [("2024-01-02", "2024-01-02 06:00:00")], FORGET)
    assert run() == (first, [("2024-01-01", "d")])
    add("rows", [("f", "2024-01-04", "2024-01-04 05:00:00")], ROW)
    add("forgets", [("2024-01-01", "2024-01-02 07:00:00")], FORGET)
    assert run() == ([("2024-01-01", x, 2) for x in "abd"] + [("2024-01-02", "c", 1), ("2024-01-02", "e", 1)], [])
