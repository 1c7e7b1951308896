"""Cases that grow with the data: hot keys, long chains, repeated rows and numbering in ranges."""

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from recollect.operators import budget, fold, reports, retrieval, tables
from recollect.plans.engine import Memory
from recollect.sources import sessions
from recollect.sources.routing import longest_prefix


def test_numbering_by_ranges(spark):
    rows = [(i * 7 % 1009, f"k{i}") for i in range(1000)] + [(None, "none")]
    df = spark.createDataFrame(rows, "x int, k string").repartition(7)
    got = [(r["n"], r["x"]) for r in tables.numbered(df, "n", F.desc_nulls_last("x")).orderBy("n").collect()]
    assert got == list(enumerate([*sorted((x for x, _ in rows if x is not None), reverse=True), None], 1))
    assert tables.numbered(df.where("false"), "n", "x").collect() == []


def test_routes_of_repeated_rows_and_nulls(spark):
    units = spark.createDataFrame([("/a/b/c", None), ("/a/b/c", None), ("/a/x", "t"), ("/q", "t"), (None, "t")], "path string, note string")
    routes = spark.createDataFrame([("/a/", "one"), ("/a/b/", "two")], "root string, home string")
    got = sorted((tuple(r) for r in longest_prefix(units, "path", routes).collect()), key=repr)
    assert got == sorted([("/a/b/c", None, "two"), ("/a/b/c", None, "two"), ("/a/x", "t", "one"), ("/q", "t", None), (None, "t", None)], key=repr)
    assert longest_prefix(units, "path", routes.where("false")).where("home is not null").collect() == []


def test_inbound_of_crowded_observations(spark):
    rng = random.Random(1)
    links = {(o, f"p{rng.randrange(60)}") for o in range(40) for _ in range(rng.choice([1, 2, 5, 40]))}
    around: dict = {}
    for _, p in links:
        around.setdefault(p, set())
    for o, p in links:
        around[p] |= {q for x, q in links if x == o} - {p}
    want = {(p, sum(q == p for _, q in links), len(found)) for p, found in around.items()}
    df = spark.createDataFrame(sorted(links), "id int, page string")
    for crowd in (0, 3, 1000):
        assert {tuple(r) for r in reports.page_inbound(df.union(df), crowd).collect()} == want


def test_earlier_digests_run_through_a_session(spark):
    rows = [("s", i, None if i == 3 else f"d{i}") for i in range(6)] + [(None, 1, "x"), (None, 2, "y")]
    df = spark.createDataFrame(rows, "session string, seq long, digest string").repartition(3)
    got = {(r["session"], r["seq"]): (r["n_earlier"], r["earlier_md5"]) for r in fold.earlier_digests(df).collect()}
    md5 = lambda *x: __import__("hashlib").md5("\n".join(x).encode()).hexdigest()
    assert got["s", 0] == (0, md5()) and got["s", 5] == (4, md5("d0", "d1", "d2", "d4")) and got[None, 2] == (1, md5("x"))
    asked = fold.digest_context(df, df.where("session = 's' and seq = 4"))
    assert [r["earlier"] for r in asked.orderBy("place").collect()] == ["d0", "d1", "d2"]


def test_changes_apply_in_the_order_of_the_log(spark):
    rows = [("a", 1, None), ("a", 3, 1), ("a", 4, 1), ("a", 5, 3), ("b", 2, 9), ("b", 6, 1)]
    got = {(r["id"], r["seq"]) for r in fold.applied(spark.createDataFrame(rows, "id string, seq long, stamp long")).collect()}
    assert got == {("a", 1), ("a", 3), ("a", 5), ("b", 2)}


def test_a_rejected_edit_is_no_change(spark, tmp_path):
    memory = Memory(spark, str(tmp_path), now="2024-06-01 00:00:00")
    memory.note("First.", ["page"])
    target = memory.state().observations.first()["id"]
    assert len(target) == 16
    memory.edit(target, 1, line="Second.")
    memory.edit(target, 1, line="Too late.")
    memory.edit(target, 2, line="Third.")
    assert memory.state().observations.first()["line"] == "Third."


def test_a_long_branch(spark, tmp_path):
    def message(id_, parent, role):
        return {"type": "message", "id": id_, "parentId": parent, "message": {"role": role, "stopReason": "stop", "content": [{"type": "text", "text": id_}]}}

    def session(name, rows):
        (tmp_path / name).mkdir()
        (tmp_path / name / "s.jsonl").write_text("".join(json.dumps(x) + "\n" for x in [{"type": "session", "id": name, "cwd": "/w"}, *rows]))
        return sessions.sessions(sessions.json_lines(spark, str(tmp_path / name)), "pi").orderBy("at")

    chain = [message(f"m{i}", f"m{i - 1}" if i else "", "assistant" if i % 2 else "user") for i in range(70)]
    strays = [message(f"x{i}", f"m{i}", "user") for i in range(0, 60, 7)]
    assert [r["id"] for r in session("long", chain[:-1] + strays + chain[-1:]).collect()] == [f"m{i}" for i in range(70)]
    with pytest.raises(Exception, match="no message has the id gone"):
        session("lost", [message("a", "gone", "user"), message("b", "a", "assistant")]).collect()
    with pytest.raises(ValueError, match="circle"):
        session("ring", [message("a", "b", "user"), message("b", "a", "assistant")])


def test_blobs(spark):
    blobs = [struct.pack("<2f", 1.5, -2.0), b"", None, b"abc", struct.pack("<f", 3.0)]
    df = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in enumerate(blobs)], "i int, b binary").coalesce(1)
    got = {r["i"]: r["v"] for r in df.select("i", retrieval.to_vector("b").alias("v")).collect()}
    assert got == {0: [1.5, -2.0], 1: [], 2: None, 3: [], 4: [3.0]}
    back = df.select("i", retrieval.to_blob(retrieval.to_vector("b")).alias("b")).orderBy("i").collect()
    assert [None if r["b"] is None else bytes(r["b"]) for r in back] == [blobs[0], b"", None, b"", blobs[4]]


def test_a_cluster_needs_a_shared_folder(spark):
    class Elsewhere:
        class conf:  # noqa: N801
            @staticmethod
            def get(name, default=None):
                return {"spark.master": "yarn"}.get(name, default)

    with pytest.raises(ValueError, match="checkpoint"):
        tables.shared_folder(Elsewhere)


def test_one_observation_on_very_many_pages(spark):
    links = spark.range(200_000).selectExpr("1L as id", "concat('p', id) as page").union(spark.range(3).selectExpr("2L as id", "concat('p', id) as page")).union(spark.sql("select 2L, 'alone'"))
    got = {r["page"]: (r["observations"], r["inbound"]) for r in reports.page_inbound(links).where("page in ('p0', 'p7', 'alone')").collect()}
    assert got == {"p0": (2, 200_000), "p7": (1, 199_999), "alone": (1, 3)}


def test_windows_of_one_large_group(spark):
    df = spark.range(1_000_000).selectExpr("'g' as g", "id", "id % 7 as n", "map('k', id) as extra")
    rows = budget.windows(df, ["g"], [F.col("id")], "n", 100)
    assert rows.columns == ["g", "id", "n", "extra", "window"]
    window, used, want = 0, 0, {}
    for i in range(1_000_000):
        n = i % 7
        window, used = (window + 1, n) if used > 0 and used + n > 100 else (window, used + n)
        if i % 99_991 == 0:
            want[i] = window
    assert {r["id"]: r["window"] for r in rows.where("id % 99991 = 0").collect()} == want
    fit = budget.first_fit(df.where("id < 50").union(spark.sql("select null, 99L, 3L, map('k', 1L)")), ["g"], [F.col("id")], "n", 10).orderBy("g", "id").collect()
    assert [r["used"] for r in fit if r["used"] is not None] == [3, 0, 1, 3, 6, 10, *[10] * 7]
