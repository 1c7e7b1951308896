"""Streams with keyed state: units that grow, are rewritten or settle, messages seen before, and sync as one command."""

import datetime as dt
import hashlib

from pyspark.sql import functions as F

from recollect.operators import fold
from recollect.plans.engine import Memory
from recollect.sources import files
from recollect.streaming import cursors

SHAPE = "path string, activity timestamp, content binary"


def put(spark, folder, name, rows):
    spark.createDataFrame([(p, dt.datetime(2024, 1, day, hour), text.encode()) for p, day, hour, text in rows], SHAPE).coalesce(1).write.parquet(f"{folder}/{name}")
    return spark.readStream.schema(SHAPE).parquet(f"{folder}/*")


def run(stream, checkpoint):
    out = []
    with cursors.state_store(stream.sparkSession):
        query = stream.writeStream.foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return sorted(out, key=repr)


WAVES = (
    [("a", 1, 0, "one"), ("b", 1, 0, "x"), ("c", 1, 0, "")],
    [("a", 2, 0, "one two"), ("b", 2, 0, "y"), ("c", 2, 0, ""), ("d", 2, 0, "é")],
    [("a", 3, 0, "one two"), ("b", 3, 0, "x and"), ("d", 3, 0, "é!"), ("a", 3, 1, "one two three"), ("d", 1, 0, "too old")],
)


def test_cursors_in_state_equal_a_table_of_cursors(spark, tmp_path):
    taken = {}
    for i, wave in enumerate(WAVES):
        stream = cursors.increments(put(spark, tmp_path / "in", str(i), wave))
        got = [r[:5] for r in run(stream, str(tmp_path / "c"))]
        want = []
        for path, _, _, text in sorted(wave, key=lambda r: r[1:3]):
            if text == "too old":
                continue
            # The table of cursors takes one version of each unit at a time.
            units = spark.createDataFrame([(path, text.encode(), len(text.encode()), hashlib.sha256(text.encode()).hexdigest())], "path string, content binary, length long, hash string")
            known = spark.createDataFrame([(p, *c) for p, c in taken.items()], "path string, length long, hash string")
            (row,) = files.increments(units, known).collect()
            want.append((row["path"], row["status"], row["text"] if row["status"] != "unchanged" else None, row["length"], row["hash"]))
            if row["status"] in ("new", "appended"):
                taken[path] = row["length"], row["hash"]
        assert got == sorted(want, key=repr)
    assert run(cursors.increments(spark.readStream.schema(SHAPE).parquet(f"{tmp_path}/in/*")), str(tmp_path / "c")) == []


def test_units_settle_by_the_watermark(spark, tmp_path):
    def step(name, rows):
        return [(r[0], r[1], r[2]) for r in run(cursors.increments(put(spark, tmp_path / "in", name, rows), settle=3.0), str(tmp_path / "c"))]

    assert step("1", [("a", 1, 0, "one"), ("b", 1, 2, "x")]) == []
    assert step("2", [("b", 1, 4, "x y")]) == [("a", "new", "one")]
    assert step("3", [("z", 1, 8, "late")]) == [("b", "new", "x y")]
    assert step("4", [("a", 2, 0, "one two"), ("q", 2, 9, "q")]) == [("a", "appended", " two"), ("z", "new", "late")]


def test_messages_wait_for_their_user(spark, tmp_path):
    def step(name, rows):
        spark.createDataFrame([(s, i, role, None, i) for s, i, role in rows], cursors.MESSAGE).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
        stream = cursors.new_messages(spark.readStream.schema(cursors.MESSAGE).parquet(f"{tmp_path}/in/*"))
        return [(r[0], r[1]) for r in run(stream, str(tmp_path / "c"))]

    assert step("1", [("s", "1", "user"), ("s", "2", "assistant"), ("t", "1", "assistant"), ("s", None, "user")]) == [("s", "1"), ("s", "2")]
    assert step("2", [("s", "2", "assistant"), ("s", "3", "assistant"), ("t", "1", "assistant")]) == []
    assert step("3", [("s", "4", "user"), ("t", "2", "user"), ("s", "1", "user")]) == [("s", "3"), ("s", "4"), ("t", "1"), ("t", "2")]


def test_sync_as_one_command(spark, tmp_path):
    memory = Memory(spark, str(tmp_path / "memory"), now="2024-06-01 00:00:00")
    routes = spark.createDataFrame([("/a", "alpha"), ("/a/b", "beta")], "root string, home string")
    sync = lambda name, rows, ck="c": memory.sync(put(spark, tmp_path / "in", name, rows), str(tmp_path / ck), routes=routes)
    first = sync("1", [("/a/x", 1, 5, "Second told."), ("/a/b/y", 1, 1, "First told."), ("/c/z", 1, 0, "Nowhere."), ("/a/e", 1, 0, " ")])
    assert (first.units, first.submitted, first.skipped, first.unrouted) == (4, 2, 2, ["/c/z"])
    again = sync("2", [("/a/x", 2, 0, "Second told. And more."), ("/a/b/y", 2, 0, "Rewritten.")])
    assert (again.units, again.submitted, again.skipped, again.rewritten) == (2, 1, 1, ["/a/b/y"])
    log = memory.log().select("seq", F.get_json_object("payload", "$.text").alias("t"), F.get_json_object("payload", "$.home").alias("h"), F.get_json_object("payload", "$.metadata.cursor.length").alias("n")).orderBy("seq")
    assert [tuple(r) for r in log.collect()] == [(1, "First told.", "beta", "11"), (2, "Second told.", "alpha", "12"), (3, " And more.", "alpha", "22")]
    # With the checkpoint lost all versions are told again: the log has them.
    lost = sync("3", [("/a/n", 3, 0, "New here.")], "other")
    assert lost.submitted == 1 and memory.log().count() == 4
    assert memory.state().observations.count() == 4


def test_entries_overtake_once_what_they_name_exists(spark):
    entries = spark.createDataFrame([(1, "edit"), (2, "source"), (3, "note"), (4, "edit"), (5, "source"), (6, "edit"), (7, "forget"), (8, "edit")], "seq long, kind string")
    refs = spark.createDataFrame([(1, "n3"), (4, "e1"), (4, "n3"), (6, "s5"), (6, "e1"), (7, "nowhere"), (8, "old")], "seq long, ref string")
    makes = spark.createDataFrame([(2, "s2"), (3, "n3"), (5, "s5"), (1, "e1"), (6, "e6")], "seq long, id string")
    known = spark.createDataFrame([("old",)], "id string")
    got = {r["seq"]: (r["phase"], r["turn"]) for r in fold.dependency_order(entries, refs, makes, known).collect()}
    assert got == {3: (0, 1), 8: (0, 1), 1: (0, 2), 4: (0, 3), 2: (1, 0), 5: (2, 0), 6: (2, 1), 7: (None, None)}
