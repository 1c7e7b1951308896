"""Page operations, search over both layers, brief modes and timelines of a memory."""

import datetime

import pytest
from pyspark.sql import functions as F

from recollect.operators import briefs, fold, graph, retrieval, timeline
from recollect.operators.budget import Brief
from recollect.plans.engine import Memory
from recollect.sources import registry


@pytest.fixture(scope="module")
def memory(spark, tmp_path_factory):
    made = Memory(spark, str(tmp_path_factory.mktemp("memory")), now="2024-06-01 00:00:00")
    made.note("Refunds need manual approval.", ["billing"])
    made.note("The harbour opens at dawn.", ["harbour"])
    made.ingest("document", "Ships dock at noon. They leave at night.", "Harbour guide")
    return made


def test_superseding_and_page_edits(spark, memory):
    s = memory.state()
    refund = s.observations.where("line like 'Refunds%'").first()
    memory.edit(refund["id"], refund["seq"], supersede=True, line="Refunds need two approvals.")
    s = memory.state()
    rows = {r["line"]: r for r in s.observations.collect()}
    assert rows["Refunds need manual approval."]["replaced_by"] == rows["Refunds need two approvals."]["id"]
    newest = rows["Refunds need two approvals."]
    memory.edit(newest["id"], newest["seq"], supersede=True, body="Since May.")
    memory.edit(refund["id"], 99, line="Too late: it was replaced.")
    s = memory.state()
    live = {r["line"]: r["body"] for r in fold.current(s.observations).collect()}
    assert live["Refunds need two approvals."] == "Since May." and not any("late" in x for x in live)
    chain = {(r["id"], r["role"]) for r in memory.history(newest["id"]).collect()}
    assert (refund["id"], "predecessor") in chain and len(chain) == 2

    page = {r["page"]: r["seq"] for r in s.pages.collect()}
    memory.edit_page("billing", page["billing"], line="Money matters", parent="harbour")
    with pytest.raises(ValueError, match="below itself"):
        memory.edit_page("harbour", 99, parent="billing")
    with pytest.raises(ValueError, match="no pages"):
        memory.edit_page("harbour", 99, merge_into="nowhere")
    s = memory.state()
    assert {r["page"]: (r["line"], r["parent"]) for r in s.pages.collect()}["billing"] == ("Money matters", "harbour")
    whole = memory.brief(page="harbour")
    assert "Refunds need two approvals." in whole.text and "dawn" in whole.text
    assert "Refunds" not in memory.brief(page="harbour-guide").text
    memory.edit_page("harbour-guide", 99, merge_into="harbour")
    s = memory.state()
    assert {r["page"] for r in s.pages.collect()} == {"billing", "harbour"}
    assert ("harbour", "harbour-guide") in {tuple(r) for r in s.names.collect()}


def test_dialogues(memory):
    for wrong in ("{}", "[1]", '[{"role": "user"}]', "[]"):
        with pytest.raises(ValueError):
            memory.ingest_dialogue(wrong, "Talk")
    seq = memory.ingest_dialogue('{"messages": [{"role": "user", "content": "Where do whales sleep?"}, {"role": "assistant", "content": "At sea."}]}', "Talk")
    assert memory.log().where(F.col("seq") == seq).where("payload like '%user:%whales%assistant:%sea%'").count() == 1


def test_search_over_both_layers(memory):
    hits = {r["layer"] for r in memory.search("ships dock at noon").collect()}
    assert hits == {"observation", "chunk"}
    scoped = memory.search(["ships dock at noon", "approvals"], pages=["billing"]).collect()
    assert scoped and all(r["layer"] == "observation" and "Refunds" in r["line"] for r in scoped)
    with pytest.raises(ValueError):
        memory.search(" ")
    said = memory.recall("ships dock at noon")
    assert "## Source passages" in said.text and "- src:3/0 Harbour guide" in said.text


def test_compositions_stand_for_lines(memory):
    s = memory.state()
    dawn = s.observations.where("line like '%dawn%'").first()["id"]
    memory.store_view("composition", "global", f"All about the harbour [{dawn}].", [dawn])
    memory.store_view("day", "2024-05-31", "On that day [x] ships came.", headline="Ships", start="2024-05-31")
    said = memory.brief()
    assert said.text.startswith("# Memory (as of 2024-06-01)") and "All about the harbour" in said.text and "## Recent" in said.text
    assert dawn in said.shown
    both = memory.brief(folder="/src/harbour")
    assert "# Project: harbour" in both.text and both.text.index("All about") < both.text.index("# Project")
    assert [r["id"] for r in memory.cited("composition:global").collect()] == [dawn]
    memory.forget(dawn)
    assert "All about the harbour" not in memory.brief().text
    assert memory.compose_input(200).tokens <= 800


def test_timeline_degrades_from_its_oldest_end(spark):
    day = datetime.date
    views = [(f"month:2023-{m:02}", "month", "w " * 60 + "[x]", f"head {m}", day(2023, m, 1)) for m in range(1, 13)]
    views += [(f"day:2024-01-{d:02}", "day", "text", "short " * 10, day(2024, 1, d)) for d in range(1, 11)]
    df = spark.createDataFrame(views, "id string, kind string, text string, headline string, start date")
    obs = spark.createDataFrame([(f"o{i:03}", "line " * (5 if i % 2 else 40), i, day(2024, 2, 1) if i % 3 else None) for i in range(60)], "id string, line string, seq long, day date")
    told, recent, shown, cut = briefs.timeline(df, obs, 9, {"o059"}, history=600, recent=300, open_=100)
    lines = told.split("\n")[1:]
    assert "[x]" not in told and briefs.estimate(told) <= 600 and briefs.estimate(recent) <= 300 and cut
    kinds = ["head" in x for x in lines]
    assert kinds == sorted(kinds, reverse=True) and any(kinds) and not all(kinds)
    # Newest first, long ones where they fit, nothing excluded or old.
    left, want = 100 - briefs.estimate("### Open days"), []
    text = "### Open days"
    for i in range(58, 9, -1):
        line = f"\n- o{i:03} {'line ' * (5 if i % 2 else 40)}" + (" (2024-02-01)" if i % 3 else "")
        if briefs.estimate(text) + briefs.estimate(line) <= 100:
            text, want = text + line, [*want, f"o{i:03}"]
    assert shown == want and left > 0
    empty = briefs.timeline(df.where("false"), obs.where("false"), 0)
    assert empty == ("", "", [], False)


def test_passages_end_where_one_does_not_fit():
    out = briefs.with_passages(Brief("x", 1), [("a", "one two"), ("b", "w " * 50), ("c", "one")], 40, "Keyword matches only.")
    assert "Keyword" in out.text and "- a one two" in out.text and "- c" not in out.text and out.truncated


def test_stored_compositions(spark):
    rows = [("v1", "composition", "global", 5, "old", ["a"]), ("v2", "composition", "global", 7, " ", ["a"]), ("v3", "composition", "global", 6, "new", ["a", "b"]), ("v4", "composition", "x", 9, "other", ["a"])]
    views = spark.createDataFrame(rows, "id string, kind string, scope string, seq long, text string, input_ids array<string>")
    shape = "id string, seq long, replaced_by string, forgotten long"
    both = spark.createDataFrame([("a", 1, None, None), ("b", 1, None, None)], shape)
    pick = lambda obs, *x: [r["id"] for r in timeline.stored_composition(views, obs, "global", *x).collect()]
    assert pick(both) == ["v3"]
    assert pick(spark.createDataFrame([("a", 1, None, None), ("b", 8, None, 8)], shape)) == ["v1"]
    assert pick(both, spark.createDataFrame([("b",)], "id string")) == []


def test_creation_order_and_walks_from_roots(spark):
    pages = spark.createDataFrame([("c", "b"), ("b", "a"), ("a", None), ("d", "old")], "page string, parent string")
    assert {tuple(r) for r in fold.creation_order(pages).collect()} == {("c", "b", 2), ("b", "a", 1), ("a", "root", 0), ("d", "old", 0)}
    with pytest.raises(ValueError, match="circle"):
        fold.creation_order(pages.where("page != 'a'").union(spark.createDataFrame([("a", "c")], "page string, parent string")))
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("x", "q")], "node string, parent string")
    from_a = {(r["node"], r["depth"]) for r in graph.descendants(edges, edges.where("node = 'a'")).collect()}
    assert from_a == {("a", 0), ("b", 1), ("c", 2)}
    assert {tuple(r) for r in graph.descendants(edges, edges.select(F.lit("q").alias("node"))).collect()} == {("q", "q", 0), ("q", "x", 1)}


def test_adapters_and_cutoffs(spark):
    with pytest.raises(ValueError, match="no source named nothing"):
        registry.adapter("nothing")
    assert {"pi", "codex", "claude-code", "files"} <= set(registry.ADAPTERS)
    rows = [("s", "1", "user", "2024-01-01T00:00:00Z"), ("s", "2", "assistant", "2024-01-03T00:00:00Z"), ("t", "3", "user", "2024-01-03T00:00:00Z"), ("t", "4", "assistant", None)]
    messages = spark.createDataFrame(rows, "session string, id string, role string, timestamp string")
    none = messages.where("false")
    assert registry.new_messages(messages, none).count() == 4
    assert [r["id"] for r in registry.new_messages(messages, none, F.lit("2024-01-02").cast("timestamp")).collect()] == ["3"]
    assert [r["id"] for r in registry.new_messages(messages, messages.where("id = '3'")).orderBy("id").collect()] == ["1", "2"]


def test_layers_share_the_best_of_a_search(spark):
    rankings = spark.createDataFrame([(0, "a", 1, 1), (0, "a", 1, 1), (0, "b", 1, 1), (1, "b", 2, 40)], "search_id long, layer string, id long, rank int")
    bonus = spark.createDataFrame([(0, "b", 9, 3)], "search_id long, layer string, id long, pages long")
    got = {(r["search_id"], r["layer"], r["id"]): r["relevance"] for r in retrieval.layered(rankings, bonus).collect()}
    assert got == {(0, "a", 1): pytest.approx(2 / 3), (0, "b", 1): pytest.approx(1 / 3), (0, "b", 9): 1.0, (1, "b", 2): 1.0}


def test_proposed_pages(spark):
    known = spark.createDataFrame([("a", "root", ["Alpha"]), ("b", "a", []), ("c", "b", None), ("d", "root", [])], "slug string, parent string, aliases array<string>")
    rows = [
        ("a", "reuse", "c", [], ["d"]),
        ("x", "create", "nowhere", ["alpha!"], ["b"]),
        ("b", "create", None, [], []),
        ("y", "reuse", "a", ["Y", "y."], ["y", "root", "gone", "d"]),
    ]
    pages = spark.createDataFrame(rows, "slug string, action string, parent string, aliases array<string>, merge_from array<string>")
    got = {tuple(r) for r in fold.page_violations(pages, known).collect()}
    assert got == {
        ("reused page does not exist", "y"), ("created page exists", "b"), ("unknown parent", "nowhere"), ("only reused pages merge others", "x"), ("root is not merged", "y"),
        ("page merged into itself", "y"), ("page merged twice", "d"), ("merged page does not exist", "gone"), ("merged page does not exist", "y"), ("name belongs to two pages", "alpha"),
        ("name belongs to two pages", "d"),
    }
    ring = pages.where("slug = 'a'").withColumn("merge_from", F.array().cast("array<string>"))
    assert {tuple(r) for r in fold.page_violations(ring, known).collect()} == {("parents run in a circle", x) for x in "abc"}
    fine = spark.createDataFrame([("a", "reuse", None, ["Alef"], ["d"]), ("n", "create", "a", [], [])], "slug string, action string, parent string, aliases array<string>, merge_from array<string>")
    assert fold.page_violations(fine, known).collect() == []
