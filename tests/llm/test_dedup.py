"""Near duplicates of texts and vectors, and line dedup, against brute force."""

import hashlib
import random

import numpy as np
import pytest

from recollect.llm import minhash_dedup as mh
from recollect.llm.components import connected_components
from recollect.llm.cuckoo import CuckooFilter
from recollect.llm.embedding_dedup import MultiIndex, near_duplicate_vectors
from recollect.llm.line_dedup import LineIndex, without_repeated_lines

DOCS = "doc_id long, text string"


def components(ids, links):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {i: root(i) for i in ids}


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_near(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = list(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {(i, len(sets[i]), c, c == i) for i, c in components(ids, links).items()}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return out


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(3)
    rows, n = [], 0
    for group in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([8, 60, 200]))]
        for _ in range(rng.choice([1, 2, 15])):
            rows.append((n, " ".join(edited(rng, base, rng.choice([0, 1, 3, 8])))))
            n += 1
    # A group whose smallest id is a stranger that shares a long passage with all.
    passage = [f"p{i}" for i in range(60)]
    for _ in range(12):
        rows.append((n, " ".join(passage + [f"q{n}_{i}" for i in range(30)])))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "One two"), (n + 4, "one TWO"), (n + 5, "É two"), (n + 6, "é two"), (-5, rows[3][1].upper())]
    got = {tuple(r) for r in mh.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_near(rows)


def test_near_duplicates_compared_in_blocks(spark, monkeypatch):
    """Groups whose links lie across and beside the first comparisons, in blocks of a few."""
    for name, value in {"STARS": 1, "BLOCK": 3, "MASS": 250, "PARTNERS": 5, "HOT": 4}.items():
        monkeypatch.setattr(mh, name, value)
    rng = random.Random(8)
    rows, n = [], 0
    for _ in range(3):
        base = [f"w{rng.randrange(5000)}" for _ in range(90)]
        for _ in range(5):
            # Each branch is some way from the base, its leaves near the branch.
            branch = edited(rng, base, 3)
            for _ in range(6):
                rows.append((n, " ".join(edited(rng, branch, rng.choice([0, 1, 2])))))
                n += 1
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    got = {tuple(r) for r in mh.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_near(rows)
    assert 3 < len({c for _, _, c, _ in got}) < len(rows)


def test_near_duplicates_of_odd_tables(spark):
    assert mh.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(None, "a b c d e f", 1), (2, "a b c d e f", 2), (2, "a b c d e f", 2), (1, "x " * 50_000, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    got = sorted(map(tuple, mh.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (2, 2, 2, True), (2, 2, 2, True), (1, 1, 1, True)], key=str)


def test_estimate_follows_similarity(spark):
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 800, dtype=np.uint64)
    a, b = np.unique(pool[:700]), np.unique(pool[100:])
    x, y = (mh.packed(mh.minima(s)).view(np.int64).tolist() for s in (a, b))
    row = spark.createDataFrame([(x, y)], "x array<long>, y array<long>").select(mh.estimate("x", "y")).first()
    assert abs(row[0] - 600 / 800) < 0.15


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (None, 3)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 150)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def vector_rows(rng, n, dim):
    base = rng.normal(size=(n, dim)).astype(np.float32)
    near = base[: n // 4] + 0.1 * rng.normal(size=(n // 4, dim)).astype(np.float32)
    twins = base[: n // 8]
    return [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near, twins]))]


def brute_vectors(rows, least=0.95):
    good = {i: np.array(v, np.float64) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = list(good)
    cos = lambda a, b: len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if cos(good[a], good[b])]
    part = components([i for i, _ in rows], links)
    n = {i: sum(i in x for x in links) for i in part}
    return {(i, n[i], part[i], part[i] == i) for i in part}


def test_vectors_match_brute_force(spark):
    rows = vector_rows(np.random.default_rng(5), 400, 64)
    nan = float("nan")
    rows += [(1000, None), (1001, []), (1002, [0.0] * 64), (1003, [nan] * 64), (1004, [None] * 64), (1005, [1.0, 2.0]), (1006, [2.0, 4.0]), (1007, [float("inf")] * 64)]
    got = {tuple(r) for r in near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    want = brute_vectors(rows)
    links = {r[0]: r[1] for r in want}
    found = sum(min(r[1], links[r[0]]) for r in got)
    assert found >= 0.99 * sum(links.values()), "recall"
    assert all(r[1] <= links[r[0]] for r in got), "no pair below the limit"
    assert len(got) == len(rows)
    if found == sum(links.values()):
        assert got == want


SPECTRA = {"decaying": 1 / np.arange(1, 65), "slowly decaying": np.arange(1, 65) ** -0.5, "rank 8": np.arange(64) < 8, "rank 4": np.arange(64) < 4}


def spread(rng, n, spectrum):
    x = rng.normal(size=(n, 64)) * spectrum @ np.linalg.qr(rng.normal(size=(64, 64)))[0]
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("kind", SPECTRA)
def test_visits_reach_partners_inside_the_span(kind):
    units = spread(np.random.default_rng(1), 20_000, SPECTRA[kind])
    index = MultiIndex(units, 25)
    x, away = units[:3000], units[10_000:13_000]
    away = away - (away * x).sum(axis=1)[:, None] * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * away / np.linalg.norm(away, axis=1)[:, None]
    home_x, home_y = index.cells(x, 1), index.cells(y, 1)
    met = (index.cells(x, index.visits) == home_y).any(axis=1)
    assert (met == (index.needed(x, home_y[:, 0]) <= index.visits)).mean() > 0.999
    assert (met | (index.cells(y, index.visits) == home_x).any(axis=1)).mean() >= 0.99


def test_links_of_low_rank_vectors_match_brute_force(spark):
    units = spread(np.random.default_rng(3), 2000, SPECTRA["rank 4"]).astype(np.float32)
    got = near_duplicate_vectors(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(units)], "vec_id long, embedding array<float>")).collect()
    exact = units.astype(np.float64)
    exact /= np.linalg.norm(exact, axis=1)[:, None]
    want = (exact @ exact.T >= 0.95).sum(axis=1) - 1
    found = sum(r["n_links"] for r in got)
    assert len(got) == 2000 and all(r["n_links"] <= want[r["vec_id"]] for r in got)
    assert found >= 0.99 * want.sum()


def test_vectors_of_odd_tables(spark):
    shape = "vec_id long, embedding array<float>, n_links string"
    assert near_duplicate_vectors(spark.createDataFrame([], shape)).collect() == []
    assert [tuple(r) for r in near_duplicate_vectors(spark.createDataFrame([(4, None, "x")], shape)).collect()] == [(4, 0, 4, True)]
    rows = [(None, [1.0, 0.0], "x"), (9, [1.0, 0.0], "y"), (3, [1.0, 0.0], "z"), (5, [-1.0, 0.0], "z")]
    got = {tuple(r) for r in near_duplicate_vectors(spark.createDataFrame(rows, shape)).collect()}
    assert got == {(None, 0, None, True), (9, 1, 3, False), (3, 1, 3, True), (5, 0, 5, True)}


LONG = "This line is long enough to be counted by the rule, surely."


def brute_lines(rows, min_chars=40, min_docs=5):
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = line.strip(strip).translate(lower)
            if len(key) >= min_chars:
                holders.setdefault(key, set()).add(i)
    out = set()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(h := holders.get(x.strip(strip).translate(lower), ())) >= min_docs and max(h) != i)]
        out.add((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup_matches_brute_force(spark):
    rows = [(i, f"own {i}\n{LONG if i % 2 else LONG.upper()}  \n\tshort\n{LONG}") for i in range(6)]
    rows += [(10 + i, "é" * 40 + "\n" + "x" * 39 + "\n" + LONG[:-1]) for i in range(5)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (23, ("y" * 45 + "\n") * 2000)]
    got = {(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in without_repeated_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_of_odd_tables(spark):
    shape = "doc_id long, text string, n_lines string, key string"
    assert without_repeated_lines(spark.createDataFrame([], shape)).collect() == []
    rows = [(None, LONG, "a", "k")] * 6 + [(1, LONG, "b", "k")] * 6
    got = without_repeated_lines(spark.createDataFrame(rows, shape))
    assert got.columns == ["doc_id", "text", "key", "n_lines", "n_dropped"]
    assert {tuple(r) for r in got.collect()} == {(None, LONG, "k", 1, 0), (1, LONG, "k", 1, 0)}


def test_line_index_is_reversible(spark):
    first = spark.createDataFrame([(i, LONG) for i in range(4)], DOCS)
    more = spark.createDataFrame([(9, LONG + "\nanother line"), (10, LONG)], DOCS)
    index = LineIndex.of(first)
    assert index.drops().count() == 0
    grown = index.insert(more)
    assert sorted(r["doc_id"] for r in grown.drops().collect()) == [0, 1, 2, 3, 9]
    back = grown.delete(more.select("doc_id"))
    assert back.drops().count() == 0
    assert {tuple(r) for r in back.refs.collect()} == {tuple(r) for r in index.refs.collect()}
    assert sorted(r["doc_id"] for r in back.insert(more).drops().collect()) == [0, 1, 2, 3, 9]


def test_cuckoo_filter():
    keys = [hashlib.md5(str(i).encode()).digest() for i in range(5000)]
    made = CuckooFilter.load(CuckooFilter.of(keys).dump())
    both = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)
    assert made.contains(both).all()
    for key in keys[:2500]:
        made.delete(key)
    assert made.contains(both[2500:]).all()
    assert made.contains(both[:2500]).mean() < 0.01


@pytest.mark.parametrize("text", [None, "", "a", "a b c d", "a b c d e", "A b c d E f " * 40])
def test_shingles(text):
    assert len(mh.shingle_hashes(text.encode() if text is not None else None, mh._WordHashes())) == len(shingles(text))
