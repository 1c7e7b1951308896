"""Near-duplicate documents by b-bit MinHash.

A document is its set of distinct five-word shingles. Each set gets minima under
``PERMUTATIONS`` hash functions; runs of ``ROWS`` full minima make the band keys,
and the lowest ``BITS`` bits of every minimum, packed into longs, make the
signature. Sets that share a band key are candidates, the number of equal bit
groups estimates their similarity corrected for chance agreement, and pairs whose
estimate is not clearly too low are checked on the full sets.

Scale: equal sets collapse into one class first, so copies are never compared. Of the
smallest classes of its buckets, each class is then compared with the one it meets
most often, and if that leaves them apart with the next, for ``STARS`` rounds; those
pairs, one for a class and round, join most of a group into one component; a class
that very many meet sends its text to several tasks. Classes that still stand outside
the component of some bucket's smallest class are compared with the bucket's other
components in blocks of bounded size, by signature, and those with a likely partner in
the other block on full sets, which gives a forest of links. Two classes that
share a bucket therefore end up in one component or have been compared, whatever the
size of the bucket, and no step makes all pairs of a group into rows. At similarity
0.75 a pair shares no bucket with probability (1 - 0.75 ** 4) ** 52 < 3e-9, and an
estimate falls below ``FLOOR`` with one of about the same order. The table of texts is
shuffled once, to pick those that some bucket repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.components import connected_components
from recollect.llm.shared import lean, stored

SHINGLE = 5
PERMUTATIONS, ROWS, BITS = 208, 4, 4
BANDS, LANES = PERMUTATIONS // ROWS, PERMUTATIONS * BITS // 64
#: Pairs estimated below this are dropped unchecked: six deviations under 0.75.
FLOOR = 0.55
#: Classes, and shingles of theirs, on either side of what one task compares at once; and
#: partners of a class in one task.
BLOCK, MASS, PARTNERS = 2048, 2_000_000, 128
#: Most keys that are broadcast: those of more than one in HOT of a table's rows.
HOT = 2000
#: Rounds in which a class is compared with one smallest class of its buckets.
STARS = 3
_CACHE = 200_000
#: Most unequal bit groups of a pair whose estimate is FLOOR or more.
MOST_UNEQUAL = int(PERMUTATIONS * (1 - FLOOR) * (1 - 2.0**-BITS))

_rng = np.random.default_rng(20240607)
_MUL = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)
_PLACE = _rng.integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: The lowest bit of each group of BITS.
_LOW = np.uint64(0x1111111111111111)


class _WordHashes(dict):
    """64-bit hashes of words; forgets all when full, so its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(text: bytes | None, words: _WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; fewer words make one shingle."""
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    width = min(SHINGLE, len(h))
    n = len(h) - width + 1
    out = np.full(n, np.uint64(len(h) if width < SHINGLE else SHINGLE))
    for i in range(width):
        out += h[i : i + n] * _PLACE[i]
    out ^= out >> np.uint64(29)
    out *= _MIX
    out ^= out >> np.uint64(32)
    return np.unique(out)


def minima(shingles: np.ndarray) -> np.ndarray:
    x = shingles.astype(np.uint32)
    out = np.full(PERMUTATIONS, np.uint32(0xFFFFFFFF))
    for i in range(0, len(x), 512):
        h = x[i : i + 512, None] * _MUL
        h += _ADD
        np.minimum(out, h.min(axis=0), out=out)
    return out


def packed(least: np.ndarray) -> np.ndarray:
    """The lowest BITS bits of each minimum, 64 / BITS to a long."""
    low = (least & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(LANES, 64 // BITS)
    return np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=1)


def band_keys(least: np.ndarray) -> list[int]:
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh3_64_intdigest(rows[i].tobytes(), seed=i) for i in range(BANDS)]


@lean
def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _WordHashes()
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        sizes, digests, signs, bands = [], [], [], []
        for value in texts:
            shingles = shingle_hashes(value.as_py(), words)
            sizes.append(len(shingles))
            if not len(shingles):
                digests.append(None), signs.append(None), bands.append(None)
                continue
            least = minima(shingles)
            digests.append(xxhash.xxh3_128_digest(shingles.tobytes()))
            signs.append(packed(least).view(np.int64))
            bands.append(np.array(band_keys(least), np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))],
            names=["id", "n_shingles", "set_hash", "sign", "bands"],
        )


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, set_hash, sign, bands) of every row; the last three null without words."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _signatures, "id long, n_shingles long, set_hash binary, sign array<long>, bands array<long>"
    )


def _differing(x: str) -> str:
    return f"bit_count(({x} | shiftrightunsigned({x}, 1) | shiftrightunsigned({x}, 2) | shiftrightunsigned({x}, 3)) & 1229782938247303441L)"


def estimate(left: str, right: str) -> Column:
    """Similarity from equal bit groups, less the share that agrees by chance."""
    unequal = F.expr(f"aggregate(zip_with({left}, {right}, (x, y) -> {_differing('(x ^ y)')}), 0, (s, x) -> s + x)")
    chance = 2.0**-BITS
    return ((1 - unequal / F.lit(float(PERMUTATIONS))) - chance) / (1 - chance)


def _linked(left: np.ndarray, right: np.ndarray) -> bool:
    both = len(np.intersect1d(left, right, assume_unique=True))
    return both > 0 and 100 * both >= 75 * (len(left) + len(right) - both)


@lean
def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each centre, whose texts come first, with the texts that follow."""
    words, centre, own = _WordHashes(), None, []
    for batch in batches:
        out = []
        for a, salt, b, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3).cast(pa.large_binary()), strict=True):
            if (a, salt) != centre:
                centre, own = (a, salt), []
            shingles = shingle_hashes(text.as_py(), words)
            if a == b:
                own.append(shingles)
            elif any(_linked(x, shingles) for x in own):
                out.append((a, b))
        yield _pairs(out)


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _met(rows: DataFrame, side: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """``rows`` joined with ``side``, which has a row for each key, without dealing hot keys to one task.

    ``counts`` has the key and n, its rows. Keys of more than one row in HOT, of which
    there are at most HOT, meet their row of ``side`` by a broadcast.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("n") > total // HOT).select(key))
    often = rows.join(F.broadcast(side.join(hot, key, "left_semi")), key)
    return often.unionByName(rows.join(hot, key, "left_anti").join(side, key))


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b), a < b, whose full shingle sets are similar enough; ``texts`` has id and text.

    The partners of a centre a are dealt over tasks, ``PARTNERS`` to each, and stream
    past its own text, so that neither a centre's pairs nor two texts for each pair
    come together.
    """
    salts = stored(pairs.groupBy("a").agg(F.count("*").alias("n"), F.ceil(F.count("*") / PARTNERS).cast("int").alias("salts")), "centres")
    centres = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("id"))
    others = _met(pairs, salts.select("a", "salts"), "a", salts).select("a", F.pmod(F.xxhash64("b", F.lit(4)), F.col("salts")).cast("int").alias("salt"), F.col("b").alias("id"))
    rows = centres.union(others).join(texts, "id").select("a", "salt", "id", "text")
    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "id").mapInArrow(_stars, "a long, b long").distinct()


def _worth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of two blocks of classes those that have a partner in the other, of another component, by the estimate."""
    rows = pa.Table.from_batches(list(batches))
    signs = np.stack([np.array(x, np.int64) for x in rows["sign"].to_pylist()]).view(np.uint64)
    labels, side = rows["component"].to_numpy(), rows["side"].to_numpy()
    askers, held = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
    found = np.zeros(len(rows), bool)
    for i in askers:
        x = signs[i] ^ signs[held]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        near = (np.bitwise_count(x & _LOW).sum(axis=1) <= MOST_UNEQUAL) & (labels[held] != labels[i])
        if near.any():
            found[i] = True
            found[held[near]] = True
    yield from rows.drop_columns(["sign"]).filter(pa.array(found)).combine_chunks().to_batches()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between different components among the classes of two blocks, at most one for a class of the first."""
    words, rows = _WordHashes(), []
    for batch in batches:
        for x, label, side, text in zip(*(batch[c].to_pylist() for c in ("id", "component", "side")), batch["text"].cast(pa.large_binary()), strict=True):
            shingles = shingle_hashes(text.as_py(), words)
            if len(shingles):
                rows.append((x, label, shingles, side))
    askers, held = [r for r in rows if r[3] & 1], [r for r in rows if r[3] & 2]
    parent: dict = {}

    def root(label: int) -> int:
        while parent.get(label, label) != label:
            label = parent[label]
        return label

    out = []
    if askers and held:
        known = np.unique(np.concatenate([x[2] for x in askers]))
        every = np.concatenate([x[2] for x in held])
        sizes = np.array([len(x[2]) for x in held])
        at = np.minimum(np.searchsorted(known, every), len(known) - 1)
        at[known[at] != every] = len(known)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        mark = np.zeros(len(known) + 1, np.int32)
        for x in askers:
            mark[:] = 0
            mark[np.searchsorted(known, x[2])] = 1
            both = np.add.reduceat(mark[at], starts)
            for k in np.flatnonzero((both > 0) & (100 * both >= 75 * (len(x[2]) + sizes - both))):
                mine, other = root(x[1]), root(held[k][1])
                if mine != other:
                    parent[max(mine, other)] = min(mine, other)
                    out.append((x[0], held[k][0]))
    yield _pairs(out)


def unjoined(members: DataFrame, components: DataFrame) -> DataFrame:
    """The rows of ``members`` in buckets of several components, with component and main, that of the smallest class."""
    comp = members.join(components.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    main = comp.groupBy("key").agg(F.min_by("component", "rep").alias("main"), F.min("component").alias("least"), F.max("component").alias("most")).where("least != most")
    return comp.join(main.select("key", "main"), "key").select("key", "main", "rep", "component", "n_shingles")


def blocks_of(rows: DataFrame) -> DataFrame:
    """(unit, i, j, id, component, side): pairs of blocks of classes that are to be compared.

    Classes outside the main component of their bucket are compared with those inside
    and with each other. Where buckets overlap so much that it is less work, all buckets
    of one main component are taken as one unit, so that a pair that shares many of them
    is compared once; else each bucket is a unit of its own.
    """
    inside = F.col("component") == F.col("main")
    sized = lambda n: F.greatest(F.ceil(F.sum(n) / BLOCK), F.ceil(F.sum(n * F.col("n_shingles")) / MASS)).cast("int")
    here, there = inside.cast("int"), (~inside).cast("int")
    count = [F.sum(there).alias("n_out"), F.sum(here).alias("n_in"), sized(there).alias("blocks"), sized(here).alias("chunks")]
    work = F.col("n_out") * (F.col("chunks") + F.col("blocks")) + F.col("n_in") * F.col("blocks")
    by_key = rows.groupBy("main", "key").agg(*count).withColumn("work", work)
    whole = rows.select("main", "rep", "component", "n_shingles").distinct().groupBy("main").agg(*count).withColumn("work", work)
    joined = by_key.groupBy("main").agg(F.sum("work").alias("apart")).join(whole, "main").where("work <= apart").select("main", "blocks", "chunks")
    each = by_key.join(joined, "main", "left_anti").select("main", "key", "blocks", "chunks")
    placed = (
        rows.select("main", "rep", "component").distinct().join(joined, "main").select(F.col("main").alias("unit"), "main", "rep", "component", "blocks", "chunks")
        .union(rows.join(each, ["main", "key"]).select(F.col("key").alias("unit"), "main", "rep", "component", "blocks", "chunks"))
    )
    place = F.xxhash64("rep", F.lit(2))
    block, chunk = F.pmod(place, "blocks").cast("int"), F.pmod(place, "chunks").cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outer = placed.where(~inside)
    asking = outer.select("unit", block.alias("i"), upto("chunks").alias("j"), "rep", "component", F.lit(1).alias("side"))
    asked = placed.where(inside).select("unit", upto("blocks").alias("i"), chunk.alias("j"), "rep", "component", F.lit(2).alias("side"))
    between = outer.select("unit", block.alias("own"), upto("blocks").alias("other"), "rep", "component")
    side = F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2)
    between = between.select("unit", F.least("own", "other").alias("i"), (-1 - F.greatest("own", "other")).alias("j"), "rep", "component", side.alias("side"))
    return asking.union(asked).union(between).withColumnRenamed("rep", "id")


def links_between(blocks: DataFrame, signs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between classes of different components in pairs of blocks.

    Signatures (id, sign) are compared first, and only classes that have a likely
    partner in the other block send their texts; a task returns a forest, not pairs.
    """
    place, schema = ["unit", "i", "j"], "unit long, i int, j int, id long, component long, side int"
    likely = blocks.join(signs, "id").select(*place, "id", "component", "side", "sign").groupBy(*place).applyInArrow(_worth, schema)
    return stored(likely, "likely").join(texts, "id").select(*place, "id", "component", "side", "text").groupBy(*place).applyInArrow(_forest, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept), one row for each row of ``docs``.

    Links documents with 100 * intersection >= 75 * union of their shingle sets;
    component_id is the smallest id reachable, kept tells whether it is the row's own.

    Nulls: a null, empty or blank text has no shingles and links with nothing. A row
    with a null id is returned with component_id null and kept true and links with
    nothing. Texts of any length are taken whole. Pairs at the limit itself are linked;
    of equal sets the smallest id is kept. Rows that share an id count as one document:
    a link of either text is a link of both. Empty tables give empty results; other
    columns, whatever their names, are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signs = stored(signatures(docs, id_col, text_col), "signatures")
    reps = stored(
        signs.where("n_shingles > 0 and id is not null").groupBy("set_hash", "n_shingles").agg(F.min("id").alias("rep"), F.min_by(F.struct("sign", "bands"), "id").alias("x")).select("set_hash", "n_shingles", "rep", "x.sign", "x.bands"),
        "classes",
    )
    banded = reps.select("rep", "n_shingles", F.explode("bands").alias("key"))
    repeated = banded.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("key", "pivot")
    members = stored(banded.join(repeated, "key"), "members")

    named = members.select(F.col("rep").alias("id")).distinct()
    texts = stored(texts.join(named, "id", "left_semi").select("id", "text"), "texts")
    sign = reps.select("rep", "sign")
    tried = parts = None
    for _ in range(STARS):
        often = members.where("rep != pivot").select("rep", "pivot")
        if parts is not None:
            often = often.join(parts.toDF("rep", "c"), "rep", "left").join(parts.toDF("pivot", "p"), "pivot", "left").where(F.coalesce("c", "rep") != F.coalesce("p", "pivot"))
        often = often.groupBy("rep", "pivot").agg(F.count("*").alias("times"))
        if tried is not None:
            often = often.join(tried.toDF("pivot", "rep"), ["rep", "pivot"], "left_anti")
        star = often.groupBy("rep").agg(F.max_by("pivot", F.struct("times", -F.col("pivot"))).alias("a")).select("a", F.col("rep").alias("b"))
        star = stored(star, "pairs")
        tried = star if tried is None else tried.union(star)
        met = _met(star.join(sign.toDF("b", "sign_b"), "b"), sign.toDF("a", "sign_a"), "a", star.groupBy("a").agg(F.count("*").alias("n")))
        near = stored(met.where(estimate("sign_a", "sign_b") >= FLOOR).select("a", "b"), "near")
        links = confirmed(near, texts)
        parts = connected_components(links if parts is None else links.union(parts.toDF("a", "b")))
    blocks = blocks_of(stored(unjoined(members, parts), "unjoined"))
    found = links_between(blocks, sign.withColumnRenamed("rep", "id"), texts)
    # Documents that share an id, or a class, belong together.
    same = signs.where("n_shingles > 0").join(reps.select("set_hash", "rep"), "set_hash").where("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    parts = connected_components(parts.toDF("a", "b").union(found).union(same))
    return (
        signs.select("id", "n_shingles")
        .join(parts, "id", "left")
        .select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
    )
