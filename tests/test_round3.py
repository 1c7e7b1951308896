"""What earlier probes found: logs, caps, odd vectors, folder briefs and stored views."""

import pytest
from pyspark.sql import functions as F

from recollect.operators import briefs, retrieval, timeline
from recollect.plans.engine import Memory
from recollect.streaming import sync


def feed(spark, folder, rows, name):
    spark.createDataFrame(rows, "id string, at int").coalesce(1).write.parquet(f"{folder}/{name}")
    return spark.readStream.schema("id string, at int").parquet(f"{folder}/*")


def test_inputs_share_a_log(spark, tmp_path):
    log, inputs = str(tmp_path / "log"), [str(tmp_path / x) for x in "ab"]
    first = feed(spark, inputs[0], [("x", 1), ("y", 2), ("x", 3)], "1")
    assert sync.sync(first, ["id"], "at", log, str(tmp_path / "c1")) == 2
    second = feed(spark, inputs[1], [("z", 1), ("y", 9)], "1")
    assert sync.sync(second, ["id"], "at", log, str(tmp_path / "c2")) == 1
    held = lambda: {(r["id"], r["at"]) for r in spark.read.parquet(log).collect()}
    assert held() == {("x", 1), ("y", 2), ("z", 1)}
    # A lost checkpoint reads all again and appends what is new.
    again = feed(spark, inputs[0], [("w", 5)], "2")
    assert sync.sync(again, ["id"], "at", log, str(tmp_path / "c3")) == 1
    (tmp_path / "c1").rename(tmp_path / "lost")
    feed(spark, inputs[0], [("v", 6)], "3")
    assert sync.sync(again, ["id"], "at", log, str(tmp_path / "c1")) == 1
    assert held() == {("x", 1), ("y", 2), ("z", 1), ("w", 5), ("v", 6)} and spark.read.parquet(log).count() == 5
    units = spark.createDataFrame([("q", 2), ("q", 1), ("x", 0)], "id string, at int")
    assert [tuple(r) for r in sync.dry_run(units, ["id"], spark.read.parquet(log), "at").collect()] == [("q", 1)]


def test_changes_that_do_not_fit_hold_nothing_back(spark):
    long = [(f"l{i:04}", "word " * 400, 10 + i, None, None) for i in range(1200)]
    rows = long + [("s1", "short", 5000, "s2", None), ("s2", "shorter", 5001, None, 5001)]
    obs = spark.createDataFrame(rows, "id string, line string, seq long, replaced_by string, forgotten long")
    pages = spark.createDataFrame([("p", "— Page", 3), ("q", None, 4)], "page string, line string, seq long")
    told = briefs.changes(obs, pages, 3, 200)
    assert told.lines == ["- q\n", "- s1 → s2 short\n", "- s2 (forgotten) shorter\n"]
    assert (told.upto, told.n_left, told.left[0], len(told.left)) == (9, 1200, "l0000", 8)
    whole = briefs.changes(obs.where("id like 's%'"), pages, 0, 200, last=9000)
    assert (whole.upto, whole.n_left, whole.lines[0]) == (9000, 0, "- p — Page\n")
    assert briefs.changes(obs.where("false"), pages.where("false"), 7, 200).upto == 7


def test_directory_tries_subjects_behind_long_ones(spark):
    names = [f"{'very ' * 90}{i}" for i in range(300)] + ["short"]
    rows = spark.createDataFrame([(f"{p}-{k}", 1.0 - i / 1000) for i, p in enumerate(names) for k in range(3)], "id string, rank double")
    links = spark.createDataFrame([(f"{p}-{k}", p) for p in names for k in range(3)], "id string, page string")
    edges = spark.createDataFrame([(p, None) for p in names], "node string, parent string")
    assert briefs.directory(rows, links, edges, [], 100) == "\n## More\n- short (3)\n"


def test_vectors_with_odd_numbers_are_no_hits(spark):
    rows = [(1, [1.0, float("nan")]), (2, [float("inf"), 0.0]), (3, [1.0, None]), (4, [0.0, 0.0]), (5, [1.0, 0.1]), (6, None)]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, [float("nan"), 1.0])], "query_id long, vector array<double>")
    assert [(r["query_id"], r["id"]) for r in retrieval.nearest(asked, vectors).collect()] == [(7, 5)]


def test_cover_ends_at_the_week_before_this_one(spark):
    days = spark.sql("select explode(sequence(date'2024-05-01', date'2024-05-31')) as day")
    built = timeline.periods_of(days, "day").select("period").distinct()
    got = {r["period"] for r in timeline.cover(days, built, F.lit("2024-05-17").cast("date")).collect()}
    # Day 17 is in the third week of May, so the second week is told by days.
    assert got == {"week:2024-05-1", *(f"day:2024-05-{d:02}" for d in range(8, 17))}


@pytest.fixture(scope="module")
def memory(spark, tmp_path_factory):
    made = Memory(spark, str(tmp_path_factory.mktemp("memory")), now="2024-06-20 00:00:00")
    made.note("Alpha ships on Monday.", ["alphax"])
    made.note("Beta is on hold.", ["beta"])
    made.note("Alpha parts are in hall two.", ["hall"])
    made.edit_page("hall", 99, parent="alphax")
    return made


def test_a_folder_brief_knows_its_folder(memory):
    said = memory.brief(folder="/home/me/alphax", with_global=False)
    assert "Alpha ships" in said.text and "hall two" in said.text and "Beta" not in said.text
    both = memory.brief(folder="/home/me/alphax")
    assert "Beta" in both.text and both.text.count("Alpha ships") == 1


def test_hiding_a_page_hides_what_is_below_and_drops_the_composition(memory):
    hall = memory.state().observations.where("line like '%hall%'").first()["id"]
    memory.store_view("composition", "project:/home/me/alphax", "All about alpha.", [hall])
    assert "All about alpha." in memory.brief(folder="/home/me/alphax", with_global=False).text
    memory.focus("/home/me/alphax", "hall", "hide")
    said = memory.brief(folder="/home/me/alphax", with_global=False)
    assert "All about" not in said.text and "hall two" not in said.text and "Alpha ships" in said.text
    memory.focus("/home/me/alphax", "alphax", "hide")
    assert "Alpha" not in memory.brief(folder="/home/me/alphax", with_global=False).text
    memory.store_view("composition", "project:/home/me/alphax", "Told anew.", [])
    assert "Told anew." in memory.brief(folder="/home/me/alphax", with_global=False).text


def test_periods_are_told_once_and_can_be_forgotten(memory):
    for day in ("2024-03-01", "2024-06-18"):
        memory.store_view("day", day, f"Told of {day}.", headline=f"Head of {day}", start=day)
    memory.store_view("month", "2024-03", "March in short.", headline="March", start="2024-03-01")
    memory.store_view("day", "2024-06-18", "Told again.", headline="A better head", start="2024-06-18")
    text = memory.brief().text
    assert "March in short." in text and "Head of 2024-03-01" not in text
    assert text.count("A better head") == 1 and "Head of 2024-06-18" not in text
    memory.forget("day:2024-03-01")
    text = memory.brief().text
    assert "March" not in text and "A better head" in text
    assert {r["id"] for r in memory.views().where("kind != 'composition'").collect()} == {"day:2024-06-18"}
    memory.store_view("day", "2024-03-01", "Once more.", headline="Built anew", start="2024-03-01")
    assert "Built anew" in memory.brief().text


def test_changes_are_marked(memory):
    ship = memory.state().observations.where("line like '%ships%'").first()
    memory.edit(ship["id"], ship["seq"], supersede=True, line="Alpha ships on Friday.")
    heir = memory.state().observations.where("line like '%Friday%'").first()["id"]
    memory.forget(memory.state().observations.where("line like 'Beta%'").first()["id"])
    told = memory.changes(4)
    assert any(x.startswith(f"- {ship['id']} → {heir} Alpha ships on Monday.") for x in told.lines)
    assert any(" (forgotten) Beta is on hold." in x for x in told.lines) and not told.left
    with pytest.raises(ValueError):
        memory.changes(-1)


def test_evidence_is_passed_on(spark, tmp_path):
    made = Memory(spark, str(tmp_path), now="2024-06-20 00:00:00")
    made.ingest("document", "Bells ring at noon.", "Bells")
    first = made.state().observations.first()
    made.edit(first["id"], first["seq"], supersede=True, line="Bells ring at one.")
    s = made.state()
    heir = s.observations.where("line like '%one.'").first()["id"]
    assert {tuple(r) for r in s.evidence.collect()} == {("src:1/0", first["id"]), ("src:1/0", heir)}
