"""Briefs over a small memory."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from recollect.operators import briefs, budget

ROW = "id string, line string, body string, entered timestamp, happened timestamp, durability double, reach double, surprise double, directive double, confidence double, source_prior double, sources long, seq long"


@pytest.fixture(scope="module")
def memory(spark):
    day = dt.datetime(2024, 5, 1)
    rows = [(f"o{i}", f"Line number {i}.", None if i % 2 else "more", day, None, 30.0, 0.9 - i / 20, 0.5, 0.0, 0.9, 1.0, 2, i) for i in range(12)]
    obs = briefs.ranked(spark.createDataFrame(rows, ROW), F.lit("2024-05-31").cast("timestamp"))
    links = spark.createDataFrame([(f"o{i}", ("billing", "invoicing", "team")[i % 3]) for i in range(12)] + [("o0", "team")], "id string, page string")
    pages = spark.createDataFrame([("billing", "project", "Usage-based billing.", "root", 3), ("invoicing", "artifact", None, "billing", 9), ("team", "actor", None, "root", 1)], "page string, category string, line string, parent string, seq long")
    edges = pages.select(F.col("page").alias("node"), "parent")
    return obs, links, pages, edges


def test_ranks(memory):
    got = memory[0].orderBy("id").first()
    assert got["rank"] == pytest.approx(0.9 * 0.675 * 0.95 * 0.5 * 1.0 * (1 + 0.15 * 1.0986122886681098) * 1.15)
    assert got["shown"] == "- o0 [2+] Line number 0. (2; 1 May)"


def test_brief_fits_and_orders(memory):
    obs, links, pages, _ = memory
    whole = briefs.brief(obs, links, pages, "# Memory\n", 2000)
    assert sorted(whole.shown) == sorted(f"o{i}" for i in range(12)) and not whole.truncated
    assert whole.text.index("## billing") < whole.text.index("### invoicing")
    small = briefs.brief(obs, links, pages, "# Memory\n", 10)
    assert small.tokens <= briefs.LEAST


def test_directory_names_what_is_not_shown(memory):
    obs, links, _, edges = memory
    text = briefs.directory(obs, links, edges.withColumn("parent", F.when(F.col("parent") != "root", F.col("parent"))), ["o2", "o5", "o8", "o11", "o0"], 200)
    assert "billing" not in text and text == ""
    assert "- team (5)" in briefs.directory(obs, links, edges.withColumn("parent", F.when(F.col("parent") != "root", F.col("parent"))), ["o1"], 200)


def test_since_goes_on_where_it_stopped(memory):
    obs, _, pages, _ = memory
    shown, upto = briefs.since(obs, pages, 5, 1000)
    assert len(shown) == 7 and upto == 11
    shown, upto = briefs.since(obs, pages, 5, 16)
    assert len(shown) == 2 and upto == 7


def test_recall(memory, spark):
    obs, links, pages, _ = memory
    hits = spark.createDataFrame([("o7", 0.9), ("o3", 0.4), ("o1", 0.2)], "id string, score double")
    out = briefs.recall(hits, {"o3"}, obs, links, pages)
    assert set(out.shown) == {"o7", "o1"} and "Already shown: o3" in out.text


def plain_choice(pages, limit, spent, main):
    """The greedy choice as the contract states it: all lines are looked at in every step."""
    rows = sorted(((r, i, k, oid, text) for i, p in enumerate(pages) for k, (oid, r, text) in enumerate(p.lines)), key=lambda x: (-x[0], x[1], x[2]))
    spine, chosen, used, shown = spent, {}, {}, set()
    total = sum(p.affinity**4 for p in pages if p.affinity is not None)
    for most, new in ((main, True), (limit, False)):
        while True:
            best = None
            for r, i, _, oid, text in rows:
                size, cost = budget.estimate(text), 0 if i in chosen else budget.estimate("\n##" + pages[i].heading)
                closed = i not in chosen and (not new or (chosen and spine + cost > int(main * 0.3)))
                a = pages[i].affinity
                if oid in shown or closed or spent + cost + size > most or (a is not None and used.get(i, 0) + size > main * a**4 / total):
                    continue
                value = r * 0.95 ** len(chosen.get(i, ()))
                if best is None or value > best[0]:
                    best = (value, cost, size, i, oid)
            if best is None:
                break
            _, cost, size, i, oid = best
            spine, spent = spine + cost, spent + cost + size
            chosen.setdefault(i, []).append(oid)
            used[i] = used.get(i, 0) + size
            shown.add(oid)
    return shown


def test_streamed_choice_is_the_plain_one():
    rng = random.Random(3)
    for case in range(300):
        ranks = {f"o{j}": rng.choice((rng.random(), 0.5, -0.1)) for j in range(40)}
        texts = {o: "w " * rng.randint(1, 12) for o in ranks}
        pages = []
        for i in range(rng.randint(1, 12)):
            lines = sorted(rng.sample(sorted(ranks), rng.randint(1, 15)), key=lambda o: (-ranks[o], o))
            pages.append(budget.Page(f"p{i}", "h " * rng.randint(1, 5), [(o, ranks[o], texts[o]) for o in lines], None, rng.random() if case % 3 == 0 else None))
        most = rng.randint(10, 200)
        room = budget.assemble(pages, most, "t", directory=lambda covered, room: "")
        assert set(room.shown) == plain_choice(pages, most, 2, most - int(most * 0.25)), case


def of_rows(spark, rows):
    """Rows (id, rank, pages) as a brief takes them."""
    seen = spark.createDataFrame([(i, rank, dt.datetime(2024, 5, 1), f"- {i} [1] A line (1)") for i, rank, _ in rows], "id string, rank double, entered timestamp, shown string")
    links = spark.createDataFrame([(i, p) for i, _, on in rows for p in on], "id string, page string")
    names = sorted({p for _, _, on in rows for p in on})
    return seen, links, spark.createDataFrame([(p, "topic", None, None) for p in names], "page string, category string, line string, parent string")


def test_best_line_on_a_page_of_low_score_is_shown(spark):
    rows = [(f"o{p}-{k}", 0.85, [f"page{p}"]) for p in range(205) for k in range(20)] + [("best", 0.9, ["lonely"])]
    assert "best" in briefs.brief(*of_rows(spark, rows), "", 200).shown


def test_copies_do_not_crowd_out_lines_of_open_pages(spark):
    copied = [(f"copied{k}", 0.95, [f"page{p:03}" for p in range(190)]) for k in range(5)]
    out = briefs.brief(*of_rows(spark, copied + [(f"o{k:02}", 0.2, ["page000"]) for k in range(40)]), "", 200)
    assert len(out.shown) > 20 and {i for i, _, _ in copied} <= set(out.shown) and out.truncated and len(out.next) == 8
