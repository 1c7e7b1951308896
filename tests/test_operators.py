"""Packing, graphs, validation and sources on small cases worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from recollect.operators import budget, fold, graph, retrieval, timeline, validation
from recollect.sources import files, sessions
from recollect.streaming import sync


def test_assembly_takes_by_decayed_rank():
    pages = [
        budget.Page("alpha", "alpha (topic) (3)", [("a1", 0.9, "one two three"), ("a2", 0.8, "one two three"), ("a3", 0.2, "one two three")]),
        budget.Page("beta", "beta (topic) (2)", [("b1", 0.7, "one two three"), ("a1", 0.9, "one two three")], parent="alpha"),
    ]
    brief = budget.assemble(pages, 60, "# Title\n")
    assert brief.shown == ["a1", "a2", "a3", "b1"] and not brief.truncated
    assert brief.text.index("## alpha") < brief.text.index("### beta")
    small = budget.assemble(pages, 14, "# Title\n")
    assert small.shown == ["a1"] and small.truncated and small.next == ["a2", "b1", "a3"]
    assert small.tokens <= 14


def test_assembly_with_directory_and_affinity():
    pages = [budget.Page(s, f"{s} x", [(f"{s}{i}", 0.9 - i / 10, "w " * 10) for i in range(4)], affinity=a) for s, a in (("p", 1.0), ("q", 0.5))]
    brief = budget.assemble(pages, 120, "t", directory=lambda covered, room: "rest " * 5 if "p0" in covered else "")
    assert brief.text.endswith("rest ") and brief.tokens <= 120
    assert sum(x.startswith("p") for x in brief.shown) > sum(x.startswith("q") for x in brief.shown)


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "node string, parent string")


def test_closures(spark):
    tree = edges(spark, ("b", "a"), ("c", "b"), ("d", "b"), ("a", None))
    assert {tuple(r) for r in graph.descendants(tree).where("root = 'b'").collect()} == {("b", "b", 0), ("b", "c", 1), ("b", "d", 1)}
    looped = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("s", "s"))
    assert {r["node"] for r in graph.on_cycles(looped).collect()} == {"a", "b", "c", "s"}
    assert graph.ancestors(edges(spark).where("false")).collect() == []


def test_closures_of_deep_trees(spark):
    deep = edges(spark, *((f"n{i:03}", f"n{i + 1:03}") for i in range(100)), ("n000", "n090"))
    got = {(r["node"], r["ancestor"]): r["depth"] for r in graph.ancestors(deep).collect()}
    want = {(f"n{i:03}", f"n{j:03}"): j - i for i in range(101) for j in range(i, 101)}
    assert got == want | {("n000", f"n{j:03}"): j - 89 for j in range(90, 101)}
    ring = edges(spark, *((f"r{i:02}", f"r{(i + 1) % 80:02}") for i in range(80)), ("x", "r00"))
    assert {r["node"] for r in graph.on_cycles(ring).collect()} == {f"r{i:02}" for i in range(80)}
    assert graph.ancestors(deep, limit=100).count() == len(want)
    with pytest.raises(ValueError, match="deeper than 98"):
        graph.ancestors(deep, limit=98)


def test_chains(spark):
    chain = edges(spark, *((f"n{i:03}", f"n{i + 1:03}") for i in range(100)), ("p", "q"), ("q", "p"), ("z", "p"))
    got = {r["node"]: r["final"] for r in graph.final_of(chain).collect()}
    assert got == {f"n{i:03}": "n100" for i in range(101)}


def test_merged_pages(spark):
    links = spark.createDataFrame([("o1", "x"), ("o1", "y"), ("o2", "y")], "id string, page string")
    names = spark.createDataFrame([("y", "Why")], "page string, name string")
    moved, parents, named = fold.merged_pages(links, edges(spark, ("x", "root"), ("y", "root"), ("k", "y")), names, edges(spark, ("y", "x")))
    assert {tuple(r) for r in moved.select("id", "page").collect()} == {("o1", "x"), ("o2", "x")}
    assert {tuple(r) for r in parents.collect()} == {("x", "root"), ("k", "x")}
    assert {tuple(r) for r in named.collect()} == {("x", "Why"), ("x", "y")}


def test_proposals(spark):
    ops = spark.createDataFrame([(1, "create", ["c1"], [], ["k1"], "line"), (2, "update", ["c1"], [], ["k9"], None), (3, "discard", [], ["o9"], [], None)], "number int, op string, candidates array<string>, targets array<string>, page_keys array<string>, line string")
    pages = spark.createDataFrame([("k1", "my-page", "create", "topic", "My page", None), ("k2", "b", "create", "nothing", None, "b")], "key string, slug string, action string, category string, line string, parent string")
    candidates = spark.createDataFrame([("c1",), ("c2",)], "candidate string")
    observations = spark.createDataFrame([("o1",)], "target string")
    got = {r["rule"] for r in fold.proposal_violations(ops, pages, candidates, observations).collect()}
    assert got == {"candidate in two operations", "candidate not placed", "needs candidates", "unknown observation", "wrong number of observations", "needs a line", "unknown page key", "unknown category", "line repeats the name", "parents run in a circle"}


def test_overtaking(spark):
    entries = spark.createDataFrame([(1, "source"), (2, "edit"), (3, "forget")], "seq int, kind string")
    refs = spark.createDataFrame([(2, "new"), (3, "old")], "seq int, ref string")
    known = spark.createDataFrame([("old",)], "id string")
    order = fold.overtaking(entries, refs, known).orderBy("phase", "seq").collect()
    assert [r["seq"] for r in order] == [3, 1, 2]


def test_compositions(spark):
    obs = spark.createDataFrame([("a", 5, None, None), ("b", 9, "c", None)], "id string, seq int, replaced_by string, forgotten int")
    views = spark.createDataFrame([("v1", "composition", 7, ["a"]), ("v2", "composition", 7, ["a", "b"]), ("v3", "composition", 9, ["b"]), ("v4", "composition", 7, ["gone"]), ("v5", "day", 1, ["gone"])], "id string, kind string, seq int, input_ids array<string>")
    got = {r["id"]: r["valid"] for r in timeline.valid_compositions(views, obs).collect()}
    assert got == {"v1": True, "v2": False, "v3": True, "v4": False, "v5": True}


def test_extractions(spark):
    shape = "seq int, digest string, observations array<struct<candidate_id:string,evidence:array<string>,pages:array<struct<name:string,category:string>>>>"
    rows = [(1, "d", [("c", ["[src:1/0]"], [("p", "topic")])]), (2, " ", [("c", ["src:9/9"], []), ("c", ["src:2/0"], [("p", "no")])])]
    chunks = spark.createDataFrame([(1, "src:1/0"), (2, "src:2/0")], "seq int, id string")
    got = {tuple(r) for r in validation.extraction_problems(spark.createDataFrame(rows, shape), chunks).collect()}
    assert got == {(2, p) for p in ("digest must not be empty", "candidate ids must be unique", "needs a page", "evidence is no chunk", "unknown category")}


def test_nearest_and_blobs(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [2.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0])], "id long, vector array<float>")
    queries = spark.createDataFrame([(7, [3.0, 0.0])], "query_id long, vector array<float>")
    assert [(r["id"], r["rank"]) for r in retrieval.nearest(queries, vectors, 3).orderBy("rank").collect()] == [(1, 1), (3, 2), (2, 3)]
    back = vectors.select("id", retrieval.to_vector(retrieval.to_blob(F.col("vector"))).alias("v")).where("id = 2").first()
    assert back["v"] == [0.0, 2.0]
    assert retrieval.nearest(queries.where("false"), vectors).collect() == []


def transcripts(folder):
    """One session in each format; what must not be imported is marked DECOY."""
    user = lambda t: [{"type": "text", "text": t}]
    pi = [
        {"type": "session", "id": "s1", "cwd": "/w"},
        {"type": "message", "id": "a", "parentId": "", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "user", "content": user("PI-ONE")}},
        {"type": "message", "id": "x", "parentId": "a", "message": {"role": "assistant", "content": user("DECOY branch"), "stopReason": "stop"}},
        {"type": "message", "id": "b", "parentId": "a", "message": {"role": "assistant", "content": [{"type": "thinking", "thinking": "DECOY"}, *user("PI-TWO")], "stopReason": "stop"}},
        {"type": "message", "id": "c", "parentId": "b", "message": {"role": "user", "content": user("PI-THREE")}},
        {"type": "message", "id": "d", "parentId": "c", "message": {"role": "assistant", "content": user("PI-FOUR"), "stopReason": "stop"}},
    ]
    cc = [
        {"type": "user", "uuid": "a", "parentUuid": "", "sessionId": "s1", "cwd": "/w", "message": {"role": "user", "content": "CC-ONE"}},
        {"type": "assistant", "uuid": "b", "parentUuid": "a", "message": {"role": "assistant", "content": user("CC-TWO"), "stop_reason": "end_turn"}},
        {"type": "user", "uuid": "t", "parentUuid": "b", "message": {"role": "user", "content": [{"type": "tool_result", "text": "DECOY"}]}},
        {"type": "user", "uuid": "m", "parentUuid": "t", "isMeta": True, "message": {"role": "user", "content": "DECOY"}},
        {"type": "assistant", "uuid": "u", "parentUuid": "m", "message": {"role": "assistant", "content": user("DECOY unfinished"), "stop_reason": "tool_use"}},
    ]
    codex = [
        {"type": "session_meta", "payload": {"id": "s1", "cwd": "/w"}},
        {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "CX-ONE"}]}},
        {"type": "event_msg", "payload": {"type": "agent_message", "message": "DECOY"}},
        {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "CX-TWO"}]}},
        {"type": "event_msg", "payload": {"type": "task_complete"}},
        {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "DECOY not answered"}]}},
    ]
    for name, rows in (("pi", pi), ("claude-code", cc), ("codex", codex)):
        (folder / name).mkdir()
        (folder / name / "s.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))


WANTED = {"pi": ["PI-ONE", "PI-TWO", "PI-THREE", "PI-FOUR"], "claude-code": ["CC-ONE", "CC-TWO"], "codex": ["CX-ONE", "CX-TWO"]}


@pytest.mark.parametrize("provider", sessions.FORMATS)
def test_sessions(spark, tmp_path, provider):
    transcripts(tmp_path)
    rows = sessions.sessions(sessions.json_lines(spark, str(tmp_path / provider)), provider).orderBy("at").collect()
    assert [r["text"] for r in rows] == WANTED[provider]
    assert {r["session"] for r in rows} == {"s1" if provider == "pi" else f"{provider}:s1"}


def test_torn_line_and_exactly_once(spark, tmp_path):
    transcripts(tmp_path)
    path = tmp_path / "pi" / "s.jsonl"
    whole = path.read_text()
    lines = whole.splitlines(keepends=True)
    path.write_text("".join(lines[:-1]) + lines[-1][:12])
    read = lambda: sessions.sessions(sessions.json_lines(spark, str(tmp_path / "pi")), "pi").select("session", "id", "at", "text")
    assert [r["text"] for r in read().orderBy("at").collect()] == WANTED["pi"][:2]
    assert sync.dry_run(read(), ["session", "id"]).count() == 2

    log, inbox = str(tmp_path / "log"), tmp_path / "inbox"
    inbox.mkdir()
    stream = spark.readStream.schema("session string, id string, at int, text string").parquet(str(inbox / "*"))

    def run(name):
        read().write.parquet(str(inbox / name))
        return sync.sync(stream, ["session", "id"], "at", log, str(tmp_path / "cursor"))

    assert [run("1"), run("2")] == [2, 0]
    path.write_text(whole)
    assert [run("3"), run("4")] == [2, 0]
    texts = [r["text"] for r in spark.read.parquet(log).collect()]
    assert sorted(texts) == sorted(WANTED["pi"])


def test_bad_lines_raise(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"type": "x"}\n{broken\n{"type": "y"}\n')
    with pytest.raises(Exception, match="not a JSON object"):
        sessions.json_lines(spark, str(tmp_path)).collect()


def test_prefix_cursor(spark, tmp_path):
    (tmp_path / "a.md").write_text("one\n")
    (tmp_path / "b.txt").write_text("two\n")
    (tmp_path / "c.bin").write_text("no")
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip" / "d.md").write_text("no")
    units = files.text_units(spark, str(tmp_path), exclude=("**/skip/**",))
    cursors = spark.createDataFrame([(r["path"], r["length"], r["hash"]) for r in units.collect()], "path string, length long, hash string")
    assert cursors.count() == 2
    (tmp_path / "a.md").write_text("one\nmore\n")
    (tmp_path / "b.txt").write_text("changed\n")
    (tmp_path / "e.md").write_text("new")
    got = {r["path"].rsplit("/", 1)[1]: (r["status"], r["text"]) for r in files.increments(files.text_units(spark, str(tmp_path), exclude=("**/skip/**",)), cursors).collect()}
    assert got == {"a.md": ("appended", "more\n"), "b.txt": ("rewritten", None), "e.md": ("new", "new")}


def test_query_units(spark):
    good = "SELECT 'u' AS unit_id, '2024-01-01T00:00:00Z' AS time, 't' AS text"
    assert files.query_units(spark, good).count() == 1
    with pytest.raises(ValueError):
        files.query_units(spark, "SELECT 1 AS unit_id, 2 AS other")
    for bad in (f"{good} UNION ALL {good}", "SELECT '' AS unit_id, '2024-01-01T00:00:00Z' AS time, 't' AS text", "SELECT 'u' AS unit_id, '2024-01-01' AS time, 't' AS text"):
        with pytest.raises(Exception, match="unit_id|RFC"):
            files.query_units(spark, bad).collect()


def test_manifest(spark, tmp_path):
    (tmp_path / "a.txt").write_text("A")
    (tmp_path / "b.txt").write_text("B")
    listed = [{"path": str(tmp_path / "a.txt"), "kind": "document", "title": "a", "date": "2024-01-01"}, {"path": str(tmp_path / "b.txt"), "kind": "document", "title": "b"}]
    (tmp_path / "m.json").write_text(json.dumps({"sources": listed}))
    assert [r["text"] for r in files.manifest_units(spark, str(tmp_path / "m.json")).collect()] == ["B", "A"]
    listed[0]["sha256"] = "0" * 64
    (tmp_path / "n.json").write_text(json.dumps({"sources": listed}))
    with pytest.raises(Exception, match="sha256 differs"):
        files.manifest_units(spark, str(tmp_path / "n.json")).collect()


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 01:00:00"), (1, "2024-01-01 09:00:00"), (2, "2024-01-02 09:00:00")]
    events = spark.createDataFrame(rows, "unit int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in" / "1"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in" / "*"))
    spans = sync.active_spans(stream, "unit", "ts")
    query = spans.writeStream.format("memory").queryName("spans").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("spans").where("unit = 1").count() == 2
    assert sync.active_spans(events, "unit", "ts").count() == 3
