"""Sharding by a k-d tree over metadata, with DataFrame functions only.

A node with m shards is split at the weighted median (for odd m, the matching
quantile) of its widest metadata dimension, weights being bytes, until every leaf is
one shard; with ``target_bytes`` the number of shards follows from the total.
Dimensions are scaled to integers; a hash of the row breaks ties, so a value that a
third of all rows share can be split as well.

Scale: texts are read once, to be measured; all else works on a narrow table of
metadata. A median is found by histograms of ``BINS`` bins for each node, refined
inside the bin where it lies until that bin weighs less than ``TOLERANCE`` of the
node. Only a row for each node reaches the
driver, and as many are broadcast; there are never more nodes than shards. Numbering within a
shard goes by buckets of the tie-breaking hash, so no shard is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.llm.shared import stored

BINS, TOLERANCE, PER_BUCKET = 1 << 13, 1e-3, 10_000
#: Most shards: of each node a few numbers reach the driver and every task, under 10 MB in all.
MOST = 100_000
_SCALE = 2**31 - 1


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def _numbers(df: DataFrame, dims: list[str]) -> list[Column]:
    """Numeric columns as they are, others by a hash; null as the least value."""
    kinds = dict(df.dtypes)
    out = []
    for name in dims:
        number = kinds[name] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[name].startswith("decimal")
        out.append((F.col(name) if number else F.crc32(F.col(name).cast("binary"))).cast("double"))
    return out


def _values(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A table of longs, a row for each node of the level; never more rows than shards, so never more than MOST."""
    listed = ", ".join("(" + ", ".join(f"{int(v)}L" for v in row) + ")" for row in rows)
    return F.broadcast(spark.sql(f"VALUES {listed}").toDF(*names))


def _cuts(placed: DataFrame, nodes: dict[int, int], n_dims: int) -> dict[int, tuple[int, int]]:
    """(dimension, first key to the right) for each node; ``nodes`` has their shards."""
    spark = placed.sparkSession
    stats = placed.groupBy("node").agg(F.sum("size").alias("size"), *(f(f"v{d}").alias(f"{n}{d}") for d in range(n_dims) for n, f in (("lo", F.min), ("hi", F.max)))).collect()
    out, open_ = {k: (0, 0) for k in nodes}, {}
    for row in stats:
        k = row["node"]
        dim = max(range(n_dims), key=lambda d, r=row: (r[f"hi{d}"] - r[f"lo{d}"], -d))
        want = row["size"] * (nodes[k] // 2) // nodes[k]
        open_[k] = {"dim": dim, "lo": row[f"lo{dim}"] << 31, "hi": (row[f"hi{dim}"] + 1) << 31, "before": 0, "want": want, "size": row["size"]}
    while open_:
        for x in open_.values():
            x["width"] = max(1, -(-(x["hi"] - x["lo"]) // BINS))
        known = _values(spark, ["node", "dim", "lo", "hi", "width", "before", "want"], [(k, *(x[n] for n in ("dim", "lo", "hi", "width", "before", "want"))) for k, x in open_.items()])
        keyed = placed.join(known, "node").select("node", "size", _key(n_dims).alias("key"), "lo", "hi", "width")
        bins = keyed.where("key >= lo and key < hi").groupBy("node", F.expr("(key - lo) div width").alias("bin")).agg(F.sum("size").alias("w"))
        running = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = bins.join(known, "node").withColumn("upto", F.sum("w").over(running) + F.col("before"))
        met = summed.where("upto >= want").groupBy("node").agg(F.min(F.struct("bin", "upto", "w")).alias("m")).select("node", "m.*").collect()
        for row in met:
            x = open_[row["node"]]
            lo = x["lo"] + row["bin"] * x["width"]
            hi, before = lo + x["width"], row["upto"] - row["w"]
            if x["width"] == 1 or row["w"] <= TOLERANCE * x["size"]:
                out[row["node"]] = (x["dim"], lo if x["want"] - before <= row["upto"] - x["want"] else hi)
                del open_[row["node"]]
            else:
                x |= {"lo": lo, "hi": hi, "before": before}
    return out


def _key(n_dims: int) -> Column:
    """The scaled value of the dimension ``dim`` and the tie-breaking hash in one long."""
    value = F.element_at(F.array(*(f"v{i}" for i in range(n_dims))), F.col("dim").cast("int") + 1)
    return F.shiftleft(value, 31).bitwiseOR(F.col("h"))


def _split(meta: DataFrame, n_shards: int, n_dims: int) -> DataFrame:
    """``meta`` with node, the number of its shard."""
    spark, done = meta.sparkSession, []
    placed, nodes = meta.withColumn("node", F.lit(0).cast("long")), {0: n_shards}
    while inner := {k: m for k, m in nodes.items() if m > 1}:
        if len(inner) < len(nodes):
            leaves = [k for k in nodes if k not in inner]
            done.append(placed.join(_values(spark, ["node"], [(k,) for k in leaves]), "node", "left_semi"))
            placed = placed.join(_values(spark, ["node"], [(k,) for k in inner]), "node", "left_semi")
        cuts = _cuts(placed, inner, n_dims)
        known = _values(spark, ["node", "dim", "cut", "right"], [(k, *cuts[k], k + m // 2) for k, m in inner.items()])
        columns = placed.columns
        moved = F.when(_key(n_dims) < F.col("cut"), F.col("node")).otherwise(F.col("right"))
        placed = stored(placed.join(known, "node").withColumn("node", moved).select(*columns), "level")
        nodes = {x: m for k, n in inner.items() for x, m in ((k, n // 2), (k + n // 2, n - n // 2))}
    for part in done:
        placed = placed.unionByName(part)
    return placed


def shard_by_kd_tree(docs: DataFrame, n_shards: int | None = 16, target_bytes: int | None = None, dims: tuple[str, ...] = ("lang", "source", "n_chars", "doc_id"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, shard, slot), one row for each row of ``docs``.

    Shards have nearly the same bytes, a text's UTF-8 bytes and one more. Slots count
    from 0 in every shard. Give ``target_bytes`` in place of ``n_shards`` to have as
    many shards as that takes.

    Nulls: a null text counts as empty; a null in a dimension, or a dimension that is
    not a column, is the least value. Rows alike in id, text and dimensions can't be
    told apart and stay in one shard; other ties are broken by a hash. Texts of any length
    are measured whole. An empty table gives no rows; columns named like those that are
    returned are not carried.
    """
    dims = tuple(d for d in dims if d in docs.columns) or (id_col,)
    numbers = _numbers(docs, list(dims))
    text = F.col(text_col)
    meta = docs.select(
        F.col(id_col),
        text_size(text).alias("size"),
        text_crc(text).alias("text_crc32"),
        *(x.alias(f"n{i}") for i, x in enumerate(numbers)),
    ).withColumn("h", F.xxhash64(F.lit(11), id_col, "text_crc32", "size").bitwiseAND(_SCALE))
    meta = stored(meta, "metadata")
    ranges = meta.agg(F.count("*").alias("rows"), F.sum("size").alias("size"), *(f(f"n{i}").alias(f"{n}{i}") for i in range(len(dims)) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    n_rows, total = ranges["rows"], ranges["size"] or 0
    if target_bytes:
        n_shards = max(1, -(-total // target_bytes))
    if n_shards > MOST:
        raise ValueError(f"{n_shards} shards are more than {MOST}")

    def scaled(i: int) -> Column:
        lo, hi = ranges[f"lo{i}"], ranges[f"hi{i}"]
        if lo is None or hi <= lo:
            return F.lit(0).cast("long")
        share = (F.col(f"n{i}") - F.lit(lo)) / F.lit(hi - lo)
        return F.coalesce(F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * F.lit(float(_SCALE - 1))).cast("long"), F.lit(0).cast("long"))

    meta = meta.select(id_col, "size", "text_crc32", "h", *(scaled(i).alias(f"v{i}") for i in range(len(dims))))
    placed = _split(meta, n_shards, len(dims)).select(id_col, "size", "text_crc32", "h", F.col("node").cast("int").alias("shard"))

    buckets = max(1, -(-n_rows // (PER_BUCKET * n_shards)))
    placed = placed.withColumn("bucket", F.expr(f"h * {buckets} div {_SCALE + 1}"))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    offsets = counts.select("shard", "bucket", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("h", F.col(id_col).asc_nulls_first(), "text_crc32", "size")) - 1
    slotted = placed.withColumn("inside", inside).join(offsets, ["shard", "bucket"])
    return slotted.select(id_col, "size", "text_crc32", "shard", (F.col("before") + F.col("inside")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, shards: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Writes ``docs`` with their shard and slot as Parquet, a folder for each shard, by slot.

    ``shards`` are those of the same documents, whose ids are to be unique; one of them
    may be null. Columns named shard or slot are replaced; an empty table writes no rows.
    """
    placed = shards.select(F.col(id_col).alias("__id"), "shard", "slot")
    joined = docs.drop("shard", "slot").join(placed, docs[id_col].eqNullSafe(F.col("__id"))).drop("__id")
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
