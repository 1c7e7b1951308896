"""Hard negatives, repeated passages and spelling variants against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recollect.llm import hard_negatives as hn
from recollect.llm import repeated_passages as rp
from recollect.llm import spelling_variants as sv

SF = "/root/testdata/sf0.001"


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_threshold_join_finds_all_pairs(seed):
    rng = np.random.default_rng(seed)
    d = int(rng.integers(0, 40))
    a, r = rng.integers(-30, 60, (int(rng.integers(1, 300)), d)), rng.integers(-30, 60, (int(rng.integers(1, 60)), d))
    if seed % 3 == 0:
        a[:, d // 2 :] //= 10
        r[:, d // 2 :] //= 10
    scores = a @ r.T
    least = np.quantile(scores, rng.random(len(a))) if seed % 5 and d else np.full(len(a), -np.inf)
    least = np.maximum(least, np.quantile(scores, 0.9)) if seed % 7 == 0 else least
    barred = rng.random(scores.shape) < 0.2 if seed % 2 else None
    fits = (scores >= least[:, None]) & (True if barred is None else ~barred)
    got = [(int(i), int(j), int(x)) for found in hn.found_pairs(a, r, least, barred) for i, j, x in zip(*found, strict=True)]
    assert sorted(got) == sorted((int(i), int(j), int(scores[i, j])) for i, j in zip(*np.nonzero(fits), strict=True))


def test_threshold_join_of_large_numbers_is_exact():
    a = np.array([[2**26 + 1, 3, -5]], np.int64)
    r = np.array([[2**26 - 1, 7, 1], [2**26 - 1, 7, 2]], np.int64)
    (found,) = hn.found_pairs(a, r, np.array([-np.inf]))
    assert {int(j): int(x) for j, x in zip(found[1], found[2], strict=True)} == {0: (2**26 + 1) * (2**26 - 1) + 16, 1: (2**26 + 1) * (2**26 - 1) + 11}


def negatives_by_hand(rows):
    fit = {(i, label, tuple(np.floor(256 * x) for x in v)) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i, label, v in fit:
        if i % 50:
            continue
        score = lambda w: int(sum(x * y for x, y in zip(v, w, strict=True)))  # noqa: E731, B023
        others = [(-score(w), j, own) for j, own, w in fit if j != i and len(w) == len(v)]
        for s, j, _ in sorted(x for x in others if x[2] == label)[:5]:
            inside = sorted((t, n) for t, n, own in others if own != label and 50 * -s <= 100 * -t <= 95 * -s)
            out += [(i, j, k + 1, n, -s, -t) for k, (t, n) in enumerate(inside[:3])]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(hn.ANCHORS, hn.MEMBERS, hn.SAMPLE), (3, 40, 30), (2, 9, 1)])
def test_hard_negatives(spark, sizes):
    rng = np.random.default_rng(4)
    rows = [(int(i), int(rng.integers(3)), [float(x) for x in rng.normal(0.3, 0.4, 6).round(1)]) for i in range(260)]
    rows += [(1000 + i, i % 2, rows[50][2]) for i in range(60)]  # a vector that many share
    rows += [rows[100], (100, 2, rows[7][2]), (300, None, rows[1][2]), (None, 1, rows[1][2]), (350, 1, None), (400, 1, [float("nan")] * 6), (450, 1, [None] * 6), (500, 1, [0.0] * 6), (550, 0, [1.0, 2.0]), (551, 0, [1.0, 2.0]), (552, 1, [0.6, 1.2]), (600, 0, [])]
    df = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "vec_id long, label int, embedding array<double>, score double, key string")
    assert sorted(map(tuple, hn.hard_negatives(df, sizes=sizes).collect())) == negatives_by_hand(rows)
    if sizes[0] == hn.ANCHORS:
        assert hn.hard_negatives(df.where("false")).collect() == []
        assert hn.hard_negatives(df.withColumn("embedding", hn.F.expr("transform(embedding, x -> 1e30)"))).collect() == [], "too large to score"


def passages_by_hand(texts):
    met = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if met[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_blocks_hold_each_string_once_with_its_first_trigger(seed):
    rng = random.Random(seed)
    n = rng.randint(300, 6000)
    data = np.frombuffer(bytes(rng.choice(b"ab\n" if seed % 3 else b"abcdefghijklmnop") for _ in range(n)), np.uint8)
    data = np.tile(data[: rng.randint(1, 40)], n)[:n] if seed % 4 == 0 else data
    starts = np.array([0, *sorted(rng.sample(range(n + 1), 5)), n])
    docs = np.flatnonzero(np.diff(starts) >= 200)
    first, last = starts[docs], starts[docs + 1] - 200
    got = [(i, kind, tick) for kind, tick, low, high in zip(*rp.blocks(data, first, last), strict=True) for i in range(low, high + 1)]
    assert sorted(i for i, *_ in got) == [i for a, b in zip(first, last, strict=True) for i in range(a, b + 1)]
    h = rp.rolling(data)
    for i, kind, tick in got:
        rare, dense = (np.flatnonzero(h[i : i + rp.REACH + 1] % x == 0) for x in (rp.RARE, rp.DENSE))
        ticks = rare if len(rare) else dense
        assert tick - i == (ticks[0] if len(ticks) else 0)
        assert kind == (rp.BARE if not len(ticks) else (rp.NEAR if len(rare) else rp.DENSE_NEAR) + int(ticks[0] >= rp.SPAN))


def test_order_of_suffixes_and_continuations():
    rng = random.Random(5)
    for _ in range(30):
        parts = ["".join(rng.choice("ab") for _ in range(260)) for _ in range(3)]
        entries = []
        for _ in range(8):
            left, right = rng.choice(parts), rng.choice(parts)
            cut = rng.randint(0, 90)
            text = (left[130 - cut : 130] + parts[0][:30] + right[130:])[: 200 + rng.randint(0, cut)]
            entries.append((cut, text.encode()))
        met = Counter((tick - i, text[i : i + 200]) for tick, text in entries for i in range(min(tick, len(text) - 200) + 1))
        want = [{i for i in range(min(tick, len(text) - 200) + 1) if met[tick - i, text[i : i + 200]] > 1} for tick, text in entries]
        assert [set(x) for x in rp.repeated_in_order(entries)] == want


@pytest.mark.parametrize("most", [rp.MOST, 3])
def test_repeated_passages(spark, most):
    rng = random.Random(most)
    words = [f"w{i}" * rng.randint(1, 3) for i in range(400)]
    told = [" ".join(rng.choice(words) for _ in range(rng.randint(20, 120))) for _ in range(12)]
    texts = []
    for _ in range(160):
        parts = []
        for _ in range(rng.randint(0, 5)):
            x, p = rng.random(), rng.choice(told)
            a = rng.randint(0, len(p) // 2)
            parts.append(p[a : a + rng.randint(100, 600)] if x < 0.5 else " ".join(rng.choice(words) for _ in range(rng.randint(5, 100))) if x < 0.9 else rng.choice(["a", "ab ", "ü\n", "xyz xyz "]) * rng.randint(1, 400))
        texts.append("".join(parts))
    texts += ["", texts[3], "é" * 300, None, "x" * 199, "x" * 200]
    rows = [(i if i % 50 else None, t, "z") for i, t in enumerate(texts)] + [(7, texts[7], "z"), (7, "other " * 50, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, first string")
    want = Counter((r[0], *x) for r, x in zip(rows, passages_by_hand([(r[1] or "").encode() for r in rows]), strict=True))
    got = rp.without_repeats(df, most=most).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    assert all(sum(r["span_lengths"]) == r["n_removed"] for r in got)
    assert rp.without_repeats(df.where("false")).collect() == []


def test_long_texts_are_cut_in_pieces(monkeypatch):
    monkeypatch.setattr(rp, "PIECE", 1000)
    data = np.random.default_rng(1).integers(97, 101, 9000).astype(np.uint8)
    starts = np.array([0, 150, 7000, 7100, 9000])
    whole = [(d, i) for begin, _, docs, first, last in rp._pieces(starts) for d, a, b in zip(docs, first, last, strict=True) for i in range(a, b + 1)]
    assert whole == [(d, i) for d in range(4) for i in range(starts[d], starts[d + 1] - 199)]


def near_by_hand(words):
    out, held = set(), set(words)
    for w in held:
        for i in range(len(w)):
            short = w[:i] + w[i + 1 :]
            if short in held:
                out |= {(w, short), (short, w)}
            out |= {(w, x) for x in held if len(x) == len(w) and x[:i] == w[:i] and x[i + 1 :] == w[i + 1 :] and x != w}
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=7), min_size=1, max_size=30, unique=True))
def test_composition_accepts_each_near_pair_once(words):
    pairs = list(sv.Composition(sorted(words)).pairs())
    assert len(pairs) == len({frozenset(p) for p in pairs})
    assert {(x, y) for x, y in pairs} | {(y, x) for x, y in pairs} == near_by_hand(words)


@given(st.lists(st.text(alphabet="abc", max_size=6), unique=True))
def test_acceptor_is_minimal_and_accepts_its_words(words):
    made = sv.Acceptor(sorted(words))
    reached, todo = set(), [(made.start, "")]
    while todo:
        state, word = todo.pop()
        if made.final[state]:
            reached.add(word)
        todo += [(t, word + c) for c, t in made.edges[state].items()]
    assert reached == set(words)
    assert len({(final, *edges.items()) for final, edges in zip(made.final, made.edges, strict=True)}) == len(made.edges)


@pytest.mark.parametrize("most", [3, 40, sv.MOST])
def test_partitions_of_the_vocabulary(spark, most):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(700)} | {"a" * 3000, "a" * 2999 + "b"})
    df = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")
    got = [tuple(r) for r in sv.near_words(df, most).collect()]
    assert len(got) == len(set(got)) and {(x, y) for x, y, _ in got} == near_by_hand(words)
    assert all(words[n - 1] == y for _, y, n in got)


def test_spelling_variants(spark):
    rng = random.Random(8)
    base = ["harbour", "garden", "Straße", "ÉCOLES", "people", "thousand"]
    texts = [" ".join(rng.choice(base) if rng.random() < 0.9 else rng.choice(["harbor", "gardenn", "peoplé", "tausand", "gerden"]) for _ in range(60)) for _ in range(40)]
    rows = [(i if i else None, t, 1) for i, t in enumerate([*texts, "", None, "x" * 100_000, "a1b2 " * 3])] + [(3, texts[3], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    counts = Counter()
    for i, t, _ in rows:
        for run in sv.RUN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = near_by_hand(words)
    form = {}
    for w, n in words.items():
        best = min(((-words[y], y) for x, y in near if x == w), default=None)
        form[w] = best[1] if best and -best[0] >= 5 * n else None
    root = lambda w: w if form[w] is None else root(form[w])
    want = {(w, form[w], root(w), n, sum(x == w for x, _ in near), form[w] and words[form[w]]) for w, n in words.items()}
    got = {tuple(r) for r in sv.spelling_variants(df).collect()}
    assert got == want and any(w[1] for w in want)
    assert sv.spelling_variants(df.where("false")).collect() == []
