"""From documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept.
All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.line_dedup import without_repeated_lines
from recollect.llm.minhash_dedup import near_duplicates
from recollect.llm.mixing import mix
from recollect.llm.packing import packed
from recollect.llm.quality import quality
from recollect.llm.shared import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts go; repeated rows are judged alike; columns may bear the names
    of measures.
    """
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    judged = quality(plain, public_tokenizers.path("piece_bpe_32k.model"), plain.columns, at["text"], at.get("lang"))
    return judged.where("kept").select(*plain.columns).toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without their repeated lines; n_chars follows the text.

    Rows without an id keep all lines; those that share one lose the same lines; columns
    may be named like those that the operator adds.
    """
    plain = docs.withColumnsRenamed({c: f"__own_{c}" for c in ("n_lines", "n_dropped")})
    cut = without_repeated_lines(plain).select(*plain.columns).toDF(*docs.columns)
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else cut


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates.

    Rows without an id, or without words, stay; rows that share an id stay or go together.
    """
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; rows of a source that share an id together."""
    return mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence; every row is packed, with or without an id."""
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("minhash_dedup", minhash_dedup), ("source_mix", source_mix), ("packing", pack)]

#: Two stages depend on tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
