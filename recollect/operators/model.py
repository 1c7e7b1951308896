"""What a language model would do, behind an interface, with an offline stand-in.

The stand-in is deterministic and makes no claim to quality: it splits at blank lines,
takes first sentences as observations, hashes terms into vectors and rates by length.
All checks of what a model returns are elsewhere and hold for any model.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.text import line_slice, terms, token_estimate
from recollect.operators.budget import windows

#: Tokens up to which a source is one chunk, and tokens of a chunk.
SINGLE_CHUNK, CHUNK, DIMENSION = 600, 400, 64


class Model(Protocol):
    """Everything a model is asked for, table by table."""

    def chunks(self, sources: DataFrame) -> DataFrame:
        """(seq, chunk, start_line, end_line, context) of sources (seq, text, label)."""

    def observations(self, chunks: DataFrame) -> DataFrame:
        """(seq, chunk, line, page) of chunks (seq, chunk, text, label)."""

    def embedded(self, text: Column) -> Column:
        """A vector for a text."""

    def ratings(self, observations: DataFrame) -> DataFrame:
        """(id, line, version, reach, surprise, directive, sensitivity) of observations (id, line)."""


class Offline:
    """The stand-in."""

    version = "offline-1"

    def chunks(self, sources: DataFrame) -> DataFrame:
        """Short sources whole, others as paragraphs packed to ``CHUNK`` tokens."""
        lines = sources.select("seq", "label", "text", token_estimate(F.col("text")).alias("tokens"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
        before = Window.partitionBy("seq").orderBy("i")
        opens = (F.col("i") == 0) | ((F.trim(F.lag("line").over(before)) == "") & (F.trim("line") != ""))
        paragraphs = lines.withColumn("p", F.sum(opens.cast("int")).over(before)).groupBy("seq", "label", "tokens", "p").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.sum(token_estimate(F.col("line"))).alias("size"))
        packed = windows(paragraphs, ["seq"], [F.col("p")], "size", CHUNK)
        number = F.when(F.col("tokens") <= SINGLE_CHUNK, 0).otherwise(F.col("window")).cast("int")
        return packed.groupBy("seq", F.col("label").alias("context"), number.alias("chunk")).agg((F.min("first") + 1).alias("start_line"), (F.max("last") + 1).alias("end_line")).select("seq", "chunk", "start_line", "end_line", "context")

    def observations(self, chunks: DataFrame) -> DataFrame:
        first = F.regexp_extract(F.trim("text"), r"^([^.!?\n]{1,300}[.!?]?)", 1)
        page = F.regexp_replace(F.regexp_replace(F.lower("label"), "[^a-z0-9]+", "-"), "^[^a-z]+|-+$", "")
        return chunks.select("seq", "chunk", first.alias("line"), F.when(F.length(page) >= 2, F.left(page, F.lit(64))).otherwise("root").alias("page")).where("trim(line) != ''")

    def embedded(self, text: Column) -> Column:
        place = F.transform(terms(text), lambda t: F.pmod(F.xxhash64(t), F.lit(DIMENSION)))
        return F.transform(F.sequence(F.lit(0), F.lit(DIMENSION - 1)), lambda i: F.size(F.filter(place, lambda p: p == i)).cast("float"))

    def ratings(self, observations: DataFrame) -> DataFrame:
        reach = F.least(F.lit(1.0), F.length("line") / 200.0)
        return observations.select("id", "line", F.lit(self.version).alias("version"), reach.alias("reach"), F.lit(0.5).alias("surprise"), F.lit(0.0).alias("directive"), F.lit(0.0).alias("sensitivity"))


def with_text(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """``chunks`` with the lines of their source that they stand for."""
    return chunks.join(sources.select("seq", F.col("text").alias("whole"), "label"), "seq").withColumn("text", line_slice(F.col("whole"), F.col("start_line"), F.col("end_line"))).drop("whole")
