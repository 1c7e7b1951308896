"""The registered queries of this subpackage against their SQL, or against plain Python where there is none."""

import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

import corpus_pipeline
from recollect.llm import quality, queries

SF = "/root/testdata/sf0.001"
TOLD = sorted(queries.ORACLE_SQL)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


@pytest.mark.parametrize("name", TOLD)
def test_query_and_sql_agree(spark, duck, name):
    found = queries.QUERIES[name](spark, SF)
    told = duck.sql(queries.ORACLE_SQL[name])
    listed = sorted(told.columns)
    rows = sorted(map(tuple, found.select(*listed).collect()), key=repr)
    want = sorted(duck.sql("SELECT " + ", ".join(f'"{c}"' for c in listed) + f" FROM ({queries.ORACLE_SQL[name]})").fetchall(), key=repr)
    if name.startswith("op5"):
        at = listed.index("target")
        assert np.allclose([r[at] for r in rows], [r[at] for r in want])
        rows, want = ([r[:at] + r[at + 1 :] for r in x] for x in (rows, want))
    assert rows == want


def test_packing_query_returns_every_id_once(spark):
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {d["doc_id"]: np.array([*model.encode(d["text"] or "", add_special_tokens=False).ids, 2], "<u4") for d in documents()}
    at = dict.fromkeys(want, 0)
    for r in queries.QUERIES["op9_packing"](spark, SF).orderBy("doc_id", "start").collect():
        ids = want[r["doc_id"]]
        assert (r["start"], r["doc_tokens"]) == (at[r["doc_id"]], len(ids))
        at[r["doc_id"]] += r["length"]
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at[r["doc_id"]]].tobytes())
    assert at == {i: len(ids) for i, ids in want.items()}


def test_sharding_query(spark):
    want = {(d["doc_id"], len((d["text"] or "").encode()) + 1, zlib.crc32((d["text"] or "").encode())) for d in documents()}
    rows = queries.QUERIES["op10_kd_sharding"](spark, SF).collect()
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == want and len(rows) == len(want)
    sizes = {}
    for r in rows:
        sizes.setdefault(r["shard"], []).append(r)
    assert sorted(sizes) == list(range(16)) and {r["law"] for r in rows} == {"bytes"}
    for own in sizes.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    largest, mean = max(r["size"] for r in rows), sum(r["size"] for r in rows) / 16
    assert all(abs(sum(r["size"] for r in own) - mean) <= 0.1 * mean + largest for own in sizes.values())


def test_pipeline_stages_of_odd_tables(spark, tmp_path):
    """Null and repeated ids, null texts, an empty table, and columns named like what stages add."""
    rng = random.Random(9)
    vocabulary = [f"{a}{b}" for a in ("house", "river", "moun", "walk", "green") for b in ("", "s", "tain", "ing", "er", "ly")]
    text = " ".join(rng.choice(vocabulary) for _ in range(300))
    rows = [(1, text, "en", "a", 5, "x"), (1, text, "en", "a", 5, "x"), (None, text + " More.", "en", None, 5, "x"), (3, None, None, "b", 0, "x"), (4, "", "en", "b", 0, "x"), (5, "short", "xx", "c", 5, "x")]
    shape = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    for data in (rows, []):
        docs = spark.createDataFrame(data, shape)
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, SF)
            if name != "packing":
                assert found.columns == docs.columns and found.dtypes == docs.dtypes, name
                docs = spark.createDataFrame(found.collect(), shape)
        got = found.collect()
        assert bool(got) == bool(data)
        assert {r["doc_id"] for r in got} <= {1, None}


def test_quality_query_measures_and_verdicts(spark):
    """Fertility of a text's words, and the bands' verdict, written out plainly."""
    model = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {d["doc_id"]: (d["text"] or "", d["lang"]) for d in documents()}
    rows = queries.QUERIES["op8_quality_rules"](spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        text, lang = texts[r["doc_id"]]
        ids = model.encode(" ".join(re.findall(r"[^\x20\x09-\x0D]+", text)))
        if not ids:
            assert r["chars_per_token"] is None and not r["kept"]
            continue
        counts = np.array(list(Counter(ids).values())) / len(ids)
        want = (sum(map(len, re.findall(r"[^\x20\x09-\x0D]+", text))) / len(ids), sum(map(model.IsByte, ids)) / len(ids), float(-(counts * np.log2(counts)).sum()), sum(map(str.isalnum, text)) / len(ids))
        assert np.allclose((r["chars_per_token"], r["byte_share"], r["token_entropy"], r["letters_per_token"]), want)
        words = text.split()
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        again = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        failed = len(words) < 50 or 2 * len(again) > len(words)
        band = quality.BANDS[r["band"]]
        assert r["band"] == lang or lang not in quality.BANDS
        inside = band.least_chars <= want[0] <= band.most_chars and want[1] <= band.most_bytes and want[2] >= band.least_entropy and want[3] >= band.least_letters
        assert (r["base_failed"], r["kept"]) == (failed, not failed and inside)


def test_bands_fitted_to_a_table(spark):
    judged = spark.range(4000).selectExpr("if(id % 2 = 0, 'en', 'rare') as band", "false as base_failed", "1.0 + id / 4000 as chars_per_token", "0.0D as byte_share", "5.0D + id / 4000 as token_entropy", "1.0D as letters_per_token").where("band = 'en' or chars_per_token < 1.1")
    bands = quality.fitted_bands(judged, tail=0.01, margin=0.1)
    assert bands.keys() == quality.BANDS.keys(), "too few rows of the other"
    en = bands["en"]
    assert en.least_chars == pytest.approx(0.9 * 1.01, abs=0.002) and en.most_chars == pytest.approx(1.1 * 1.99, abs=0.002)
    assert en.least_entropy == pytest.approx(0.9 * 5.01, abs=0.002) and en.most_bytes == pytest.approx(0.01)
    assert quality.fitted_bands(judged.where("false")) == quality.BANDS
