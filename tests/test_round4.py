"""What fails on tables of several GB: hits by blocks, ranges by the thousand, sessions and cursors in bulk, what stays on disk."""

import datetime as dt
import json

import numpy as np
import pytest

from recollect.operators import integration, retrieval
from recollect.operators.postings import Postings
from recollect.plans import catalogue
from recollect.sources import sessions
from recollect.sources.line_ranges import json_line_ranges
from recollect.streaming import cursors


def shuffled(spark, act):
    """Rows that shuffles wrote while ``act`` ran."""
    sc = spark.sparkContext

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    act()
    return written() - before


def test_hits_of_many_blocks_and_equal_vectors(spark, monkeypatch):
    """Blocks' hits meet packed, and vectors told four times tie by id wherever their blocks lie."""
    monkeypatch.setattr(retrieval, "HELD", 2000, raising=False)
    monkeypatch.setattr(retrieval, "ASKED", 100, raising=False)
    monkeypatch.setattr(retrieval, "MERGED", 8, raising=False)
    rng = np.random.default_rng(1)
    once = rng.normal(size=(700, 6)).astype(np.float32)
    all_ = np.concatenate([once] * 4)
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(all_)]
    vectors = spark.createDataFrame(rows, "id long, vector array<float>, label int").repartition(5)
    asked = vectors.where("id % 40 = 0").withColumnRenamed("id", "query_id")
    wide = all_.astype(np.float64)
    dot = lambda a, b: sum(a[..., d] * b[..., d] for d in range(6))
    for scope in ([], ["label"]):
        found = retrieval.nearest(asked, vectors, 7, scope)
        assert "Window" not in found._jdf.queryExecution().toString()
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["id"], r["rank"]))
        for q in range(0, len(all_), 40):
            score = np.clip(dot(wide[q], wide) / np.sqrt(dot(wide[q], wide[q]) * dot(wide, wide)), -1, 1)
            ids = [i for i in np.lexsort((np.arange(len(all_)), -score)) if not scope or i % 3 == q % 3][:7]
            assert got.pop(q) == [(i, n) for n, i in enumerate(ids, 1)]
        assert got == {}


def test_tasks_take_many_ranges(spark, tmp_path):
    """A range is no task: 6 GB in ranges of 64 KB would be 160,000 of them."""
    wanted = []
    for name in ("a", "b"):
        rows = [json.dumps({"n": n, "t": "x" * (n * 37 % 400)}) for n in range(900)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(rows))
        wanted += [(f"{name}.jsonl", r) for r in rows]
    for size in (64, 1000):
        read = json_line_ranges(spark, str(tmp_path), size=size)
        assert read.rdd.getNumPartitions() == 1
        assert [(r["path"].rsplit("/", 1)[1], r["line"]) for r in read.orderBy("path", "pos").collect()] == wanted


def test_cursors_share_their_state(spark, tmp_path, monkeypatch):
    """Forty units are one call and one row of state, and are told as each of them would be alone."""
    monkeypatch.setattr(cursors, "BUCKETS", 1, raising=False)
    shape = "path string, activity timestamp, content binary"
    texts = [{f"u{i}": "ab" * i for i in range(40)}, {f"u{i}": ("x" if i % 3 == 0 else "") + "ab" * i + "c" * (i % 2) for i in range(40)}]
    told = []
    for day, wave in enumerate(texts, 1):
        spark.createDataFrame([(p, dt.datetime(2024, 1, day), t.encode()) for p, t in wave.items()], shape).write.parquet(f"{tmp_path}/in/{day}")
        stream = cursors.increments(spark.readStream.schema(shape).parquet(f"{tmp_path}/in/*"))
        with cursors.state_store(spark):
            query = stream.writeStream.foreachBatch(lambda df, _: told.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
            query.awaitTermination()
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1
    want = {(p, "new", t) for p, t in texts[0].items()}
    for i, (p, t) in enumerate(texts[1].items()):
        want.add((p, "rewritten", None) if i % 3 == 0 and i else (p, "unchanged", None) if t == texts[0][p] else (p, "appended", t[2 * i :]))
    assert {(r["path"], r["status"], r["text"]) for r in told} == want


def test_an_index_is_made_without_dealing_words(spark, tmp_path, monkeypatch):
    """Texts go to the task that makes their block's rows; blocks hold all words with their places."""
    monkeypatch.setattr("recollect.operators.postings.BLOCK", 16)
    texts = {i: " ".join(f"w{i * j % 23}" for j in range(i % 9 * 7)) for i in range(100)}
    docs = spark.createDataFrame([*texts.items(), (100, None)], "id long, text string").repartition(3)
    index = Postings(spark, str(tmp_path / "index"))
    assert shuffled(spark, lambda: index.extend(docs)) < sum(len(t.split()) for t in texts.values()) / 4
    rows = index._of(index.segments(), "postings", "term string, block int, n long, max_tf int, min_size int, entries array<struct<id:long,size:int,positions:array<int>>>").collect()
    got = {(e["id"], r["term"]): (e["size"], e["positions"]) for r in rows for e in r["entries"]}
    want = {}
    for i, text in texts.items():
        words = text.split()
        for w in set(words):
            want[i, w] = (len(words), [n for n, x in enumerate(words) if x == w])
    assert got == want and len({r["block"] for r in rows}) > 3
    assert all(r["n"] == len(r["entries"]) and r["max_tf"] == max(len(e["positions"]) for e in r["entries"]) and r["min_size"] == min(e["size"] for e in r["entries"]) for r in rows)


def test_transcripts_share_files(spark, monkeypatch):
    """No conversation has a file of its own, and branches take one step however long they are."""
    written, steps = [], []
    kept = sessions.kept
    monkeypatch.setattr(sessions, "kept", lambda df: steps.append(1) or kept(df))
    monkeypatch.setattr("pyspark.sql.readwriter.DataFrameWriter.partitionBy", lambda self, *c: written.append(c) or self)
    assert catalogue.QUERIES["session_transcripts"](spark, "/root/testdata/sf0.001").count() > 0
    assert written == [] and len(steps) == 2


def test_branches_of_a_table_of_transcripts(spark):
    line = lambda id_, parent, role: json.dumps({"type": "message", "id": id_, "parentId": parent, "message": {"role": role, "stopReason": "stop", "content": id_}})
    head = lambda name: json.dumps({"type": "session", "id": name, "cwd": "/w"})
    long = [line(f"m{i}", f"m{i - 1}" if i else None, "assistant" if i % 2 else "user") for i in range(3000)]
    long.insert(7, line("m6", "m2", "user"))
    texts = {"a": [head("a"), *long], "b": [head("b"), line("m0", None, "user"), line("x", "m0", "user"), line("m1", "m0", "assistant")]}
    files = spark.createDataFrame([(p, "\n".join(rows) + "\n") for p, rows in texts.items()], "path string, value string")
    got = {}
    for r in sessions.sessions(sessions.transcript_lines(files), "pi").orderBy("path", "at").collect():
        got.setdefault(r["path"], []).append(r["id"])
    # Told twice, an id counts with its last row.
    assert got == {"a": ["m0", "m1", "m2", *(f"m{i}" for i in range(6, 3000))], "b": ["m0", "m1"]}
    for rows, fault in (([line("a", "gone", "user")], "no message has the id gone"), ([line("a", "b", "user"), line("b", "a", "user")], "circle")):
        with pytest.raises(Exception, match=fault):
            sessions.sessions(sessions.transcript_lines(spark.createDataFrame([("c", "\n".join([head("c"), *rows]))], "path string, value string")), "pi").collect()


def test_evidence_is_not_copied(spark, monkeypatch):
    """What all heirs rest on, the largest table of a graph, is read where it is used."""
    copied = []
    kept = integration.kept
    monkeypatch.setattr(integration, "kept", lambda df: copied.append(df.columns) or kept(df))
    found = catalogue.QUERIES["integrated_graph"](spark, "/root/testdata/sf0.001")
    assert found.count() > 0 and copied and ["id", "chunk"] not in copied and ["id", "entry"] not in copied
