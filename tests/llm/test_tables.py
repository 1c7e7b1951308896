"""URL rules, mixing and sharding against plain Python, and the pipeline."""

import re
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from recollect.llm import kd_sharding, mixing
from recollect.llm.query_urls import RULES
from recollect.llm.url_filter import Rule, ShiftAnd, default_globs, host_and_path, judge_urls, parse_glob


def test_urls(spark):
    urls = ["http://A.Example.org/es/x", "https://example.org/es", "http://x.com/fr/1?q=/de/", "http://com/de/#a", "http://notorg/x", "http://b.org", None, "", "no scheme/org/", "ftp://user@example.org:80/en/1", "http://example.org/en/12", "http://Ü.org/ß", "http://a.org/" + "x" * 100_000, "x://evil.com/a.org/en"]
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")

    def want(url):
        host, path = host_and_path(url)
        fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        return host, path, best and best.name, best.verdict if best else "allow"

    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(df, RULES).collect()}
    assert got == {i: want(u) for i, u in enumerate(urls)}
    assert judge_urls(df.where("false"), RULES).collect() == []
    assert {r["verdict"] for r in judge_urls(df, [], block_globs=["*"]).collect()} == {"block"}


def test_own_url_rules(spark):
    blocked = ["http://cheap-pills.example.com/en/1", "http://www.free-bets.net", "http://Casino.example.com/", "https://a.com/x/y.zip", "https://a.com/photo.jpg?x=1", "https://a.com/de/login/now", "https://a.com/wp-login.php", "http://xxx-tube.org/"]
    allowed = ["http://alphabets.example.com/en/1", "http://pillsbury.com/", "https://a.com/casino.html", "https://a.com/zip", "https://a.com/x.zip/readme", "https://a.zip", "https://a.com/loginhelp", "http://bets", None, ""]
    df = spark.createDataFrame([(u,) for u in blocked + allowed], "url string")
    got = judge_urls(df, [], block_globs=default_globs()).collect()
    assert {r["url"] for r in got if r["verdict"] == "block"} == set(blocked) and len(got) == len(df.collect())
    kept = judge_urls(df, [Rule("allow", "com"), Rule("block", "com", "/x")], block_globs=default_globs()).collect()
    assert {r["url"]: r["verdict"] for r in kept}["https://a.com/x/y.zip"] == "block"
    assert {r["url"]: r["verdict"] for r in kept}["http://cheap-pills.example.com/en/1"] == "allow"


@given(st.lists(st.text(alphabet="ab/*+", max_size=8), min_size=1, max_size=30), st.lists(st.text(alphabet="abc/", max_size=12), min_size=1, max_size=20))
def test_automaton_matches_regular_expressions(globs, urls):
    hits = ShiftAnd([parse_glob(g) for g in globs]).run(urls)
    for j, g in enumerate(globs):
        pattern = re.compile("".join(".*" if c == "*" else "[^/]*" if c == "+" else re.escape(c) for c in g), re.DOTALL)
        assert hits[:, j].tolist() == [pattern.fullmatch(u) is not None for u in urls]


def test_globs_of_many_words():
    rules = [Rule("block", f"host{i}.example", "/a") for i in range(60)]
    automaton = ShiftAnd([g for r in rules for g in r.globs()])
    hits = automaton.run(["x.host7.example/abc", "host59.example/a", "host5.example/b"])
    assert [sorted({i // 2 for i, h in enumerate(row) if h}) for row in hits] == [[7], [59], []]


def fill(sizes, weights, share=1.5, cap=2):
    """Clamp and share again until no source is above its cap."""
    budget, capped = share * sum(sizes), set()
    while True:
        left = budget - sum(cap * sizes[i] for i in capped)
        w = sum(weights[i] for i in range(len(sizes)) if i not in capped)
        t = [cap * s if i in capped else left * weights[i] / w for i, s in enumerate(sizes)]
        over = {i for i in range(len(sizes)) if i not in capped and t[i] > cap * sizes[i]}
        if not over:
            return t
        capped |= over


@pytest.mark.parametrize("sizes", [[10], [100, 1, 1, 500], [0, 0, 7], [5, 5, 5, 5, 5, 900, 3], [0]])
def test_water_filling(spark, sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    df = spark.createDataFrame([(f"s{i}", s, float(w)) for i, (s, w) in enumerate(zip(sizes, weights, strict=True))], "source string, source_size long, weight double")
    got = {r["source"]: r["target"] for r in mixing.water_fill(df).collect()}
    want = fill(sizes, weights) if sum(sizes) else [0.0] * len(sizes)
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(want)


def test_mix(spark):
    rows = [(i, "w " * (i % 17 + 1), ("a", "b", "ü", None)[i % 4 if i % 3 else 0], i) for i in range(900)] + [(None, "x y", "b", 0), (5000, None, "b", 0), (5001, "", None, 0), (7, "w " * 8, "b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    got = mixing.mixed(df).collect()
    again = mixing.mixed(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    for source in ("a", "b", "ü", None):
        own = [r for r in got if r["source"] == source]
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert abs(sum(r["size"] * r["times"] for r in own) - own[0]["target"]) <= 17
        assert all(0 <= r["times"] <= 2 for r in own)
    out = mixing.mix(df)
    assert out.columns == df.columns
    assert mixing.mixed(df.where("false")).collect() == [] and mixing.mix(df.where("false")).collect() == []
    assert {r["times"] for r in mixing.mixed(df.where("doc_id = 5000")).collect()} == {0}


@pytest.mark.parametrize("n_shards", [1, 5, 16])
def test_sharding(spark, n_shards):
    rows = [(i, "é" * (i * 37 % 211), "same" if i % 3 == 0 else f"s{i % 11}", "en", None if i % 50 == 0 else i % 100, "x") for i in range(3000)] + [(None, None, None, None, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, shard string")
    got = kd_sharding.shard_by_kd_tree(df, n_shards=n_shards).collect()
    assert len(got) == len(rows)
    text = {r[0]: (r[1] or "").encode() for r in rows}
    sizes = {}
    for r in got:
        assert (r["size"], r["text_crc32"]) == (len(text[r["doc_id"]]) + 1, zlib.crc32(text[r["doc_id"]]))
        sizes.setdefault(r["shard"], []).append((r["slot"], r["size"]))
    assert sorted(sizes) == list(range(n_shards))
    assert all(sorted(s for s, _ in own) == list(range(len(own))) for own in sizes.values())
    totals = [sum(x for _, x in own) for own in sizes.values()]
    assert max(totals) - min(totals) <= 0.02 * sum(totals) / n_shards + 5 * 423


def test_sharding_of_odd_tables(spark, tmp_path):
    shape = "doc_id long, text string"
    assert kd_sharding.shard_by_kd_tree(spark.createDataFrame([], shape)).collect() == []
    one = kd_sharding.shard_by_kd_tree(spark.createDataFrame([(1, "a"), (1, "a")], shape), n_shards=4).collect()
    assert sorted(r["slot"] for r in one) == [0, 1]
    df = spark.createDataFrame([(i, "t" * 99) for i in range(100)], shape)
    shards = kd_sharding.shard_by_kd_tree(df, n_shards=None, target_bytes=2500)
    assert shards.select("shard").distinct().count() == 4
    kd_sharding.write_shards(df, shards, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = p.quality_rules(spark, docs, "")
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    cut = p.line_dedup(spark, kept, "")
    assert cut.columns == docs.columns and cut.count() == kept.count()
    unique = p.minhash_dedup(spark, cut, "")
    assert unique.columns == docs.columns and 0 < unique.count() <= cut.count()
    mix = p.source_mix(spark, unique, "")
    assert mix.columns == docs.columns and mix.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 2
    packed = p.pack(spark, mix, "")
    assert packed.agg({"length": "sum"}).first()[0] > 0
    assert [n for n, _ in p.STAGES] == ["quality_rules", "line_dedup", "minhash_dedup", "source_mix", "packing"]
