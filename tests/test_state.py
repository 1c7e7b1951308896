"""State that moves on with the log, the stored index, and searches without a model."""

import pytest
from pyspark.sql import functions as F

from recollect.operators.model import Offline
from recollect.operators.postings import Postings
from recollect.operators import postings as stored
from recollect.operators import retrieval
from recollect.plans.engine import Memory

TABLES = ("observations", "links", "pages", "chunks", "hidden", "evidence", "names")


def told(state):
    return {t: sorted((tuple(r[c] for c in sorted(r.__fields__)) for r in getattr(state, t).collect()), key=repr) for t in TABLES}


def test_state_entry_by_entry_is_the_state_from_scratch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("recollect.plans.engine.SEGMENTS", 3)
    root = str(tmp_path)
    memory = Memory(spark, root, now="2024-06-01 00:00:00")
    id_of = lambda line: memory.state().observations.where(F.col("line") == line).first()["id"]
    step = lambda name, *args, **fields: (getattr(memory, name)(*args, **fields), memory.state())
    step("note", "The gate is red.", ["gate", "site"])
    step("ingest", "document", "The tower has a bell. It rings.\n\nMore of it.", "Tower guide")
    red = id_of("The gate is red.")
    step("edit", red, 1, line="The gate is green.", happened="2024-05-01")
    step("edit", red, 3, supersede=True, line="The gate is blue.")
    blue = id_of("The gate is blue.")
    step("edit", red, 99, line="Too late.")
    step("edit", blue, 4, body="Painted in May.")
    step("edit_page", "gate", 1, line="All about the gate", parent="site")
    step("edit_page", "tower-guide", 99, merge_into="site")
    step("focus", "/w", "site", "hide")
    step("forget", blue)
    memory.forget("src:99/0")
    step("note", "A note after the merge.", ["tower-guide"])
    # Of an id that comes later: the next entry is the 13th.
    later = spark.sql("select left(sha2('14/0', 256), 16)").first()[0]
    step("edit", later, 99, line="Changed before it was told.")
    step("note", "Told later.", ["site"])
    one_by_one = told(memory.state())
    assert memory.snapshots.newest().version > 12
    fresh = Memory(spark, root, now="2024-06-01 00:00:00")
    again = fresh.rebuild()
    assert told(again) == one_by_one
    assert told(Memory(spark, root, now="2024-06-01 00:00:00").state()) == one_by_one
    lines = {r["line"] for r in again.observations.collect()}
    assert "The gate is blue." in lines and "Too late." not in lines


def test_a_step_reads_only_new_entries(spark, tmp_path):
    class Counting(Offline):
        asked: list = []

        def chunks(self, sources):
            self.asked.append(sources.count())
            return super().chunks(sources)

    memory = Memory(spark, str(tmp_path), Counting(), now="2024-06-01 00:00:00")
    for i in range(3):
        memory.ingest("document", f"Text {i} of it.", f"Guide {i}")
        memory.state()
    assert Counting.asked == [1, 1, 1]
    assert memory.state().chunks.count() == 3 and memory.snapshots.newest().seq == 3
    Memory(spark, str(tmp_path), Counting()).state()
    assert len(Counting.asked) == 3, "a second session goes on from the tables"


def test_stored_postings_equal_a_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "BLOCK", 16)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") != 5, F.col("text")).alias("text"))
    told_ = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    queries = told_.where("query_id % 20 = 0").union(spark.createDataFrame([(-1, "the of"), (-2, ""), (-3, "nowheretobefound"), (-4, "the")], "query_id long, text string"))
    index = Postings(spark, str(tmp_path))
    assert index.bm25(queries).collect() == [] and index.phrase_hits(queries).collect() == []
    rows = lambda df: sorted((r["query_id"], r["id"], round(r["score"], 6), r["rank"]) for r in df.collect())
    moved = F.when(F.col("id") % 7 == 0, F.col("id") + 1000).otherwise(F.col("id"))
    index.extend(docs.where("id % 3 = 0").withColumn("id", moved), upto=1)
    index.extend(docs.where("id % 3 != 0 or id % 7 = 0"), docs.where("id % 7 = 0").select((F.col("id") + 1000).alias("id")), upto=2)
    phrases = told_.union(spark.createDataFrame([(-5, "the"), (-6, "the the")], "query_id long, text string"))
    want = rows(retrieval.bm25(queries, docs, 7)), sorted(map(tuple, retrieval.phrase_hits(phrases, docs).collect()))
    for _ in range(2):
        assert index.documents().count() == docs.count()
        assert (rows(index.bm25(queries, 7)), sorted(map(tuple, index.phrase_hits(phrases).collect()))) == want
        some = docs.where("id % 2 = 0").select("id")
        assert {r["id"] for r in index.bm25(queries, scope=some).collect()} <= {r["id"] for r in some.collect()}
        index.merge()
    assert len(index.segments()) == 1 and index.segments()[0]["upto"] == 2
    plan = index.bm25(queries, 7)._jdf.queryExecution().toString()
    assert "documents.parquet" not in plan


def test_search_without_a_model_says_why(spark, tmp_path):
    class Down(Offline):
        down = True

        def embedded(self, text):
            return F.when(F.lit(self.down), F.raise_error(F.lit("the model is down"))).otherwise(super().embedded(text))

    model = Down()
    memory = Memory(spark, str(tmp_path), model, now="2024-06-01 00:00:00")
    memory.note("Whales sleep at sea.", ["whales"])
    memory.ingest("document", "Harbour seals sleep on rocks.", "Seals")
    said = memory.recall("where do seals sleep")
    assert "Keyword matches only; semantic search is unavailable:" in said.text and "the model is down" in said.text
    assert {r["layer"] for r in memory.search("seals").collect()} == {"observation", "chunk"}
    model.down = False
    whole = memory.recall("where do seals sleep")
    assert "Keyword matches only" not in whole.text
    before = sorted(map(tuple, memory.search("seals sleep").collect()))
    memory.reindex()
    assert sorted(map(tuple, memory.search("seals sleep").collect())) == before
    edited = memory.state().observations.where("line like 'Whales%'").first()
    memory.edit(edited["id"], edited["seq"], line="Dolphins sleep at sea.")
    assert any("Dolphins" in r["line"] for r in memory.search("dolphins").collect())
    assert not any("Whales" in r["line"] for r in memory.search("whales").where("layer = 'observation'").collect() if r["line"])
    model.down = True
    with pytest.raises(RuntimeError, match="stays in use"):
        memory.reindex()
