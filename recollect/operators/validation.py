"""Checks of records, as reasons and as tables of what fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.calendar import parsed_date
from recollect.operators.fold import CATEGORIES

# Fixed values of the data contract.
AUTHORITIES = ("user", "agent", "third_party", "unknown")
KINDS = ("fact", "question", "commitment")
SOURCE_KINDS = ("conversation", "coding_session", "meeting", "document", "chat_log", "note_user", "note_agent")


def _blank(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit(""))) == ""


def field_problem() -> Column:
    """The first thing wrong with line, body, authority, kind, confidence and happened; null if nothing."""
    wrong_date = F.col("happened").isNotNull() & parsed_date(F.col("happened")).isNull()
    return (
        F.when(_blank("line"), "line must not be empty")
        .when(F.col("body").isNotNull() & _blank("body"), "body must not be empty")
        .when(~F.coalesce(F.col("authority").isin(*AUTHORITIES), F.lit(False)), "unknown authority")
        .when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "unknown kind")
        .when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence must be between 0 and 1")
        .when(wrong_date, "happened is not a date")
    )


def source_problem() -> Column:
    """The first thing wrong with a source's kind, text, label and happened; null if nothing."""
    wrong_date = F.col("happened").isNotNull() & parsed_date(F.col("happened")).isNull()
    return (
        F.when(~F.coalesce(F.col("kind").isin(*SOURCE_KINDS), F.lit(False)), "unknown kind")
        .when(_blank("text"), "text must not be empty")
        .when(_blank("label"), "label must not be empty")
        .when(wrong_date, "happened is not a date")
    )


def stale_ratings(observations: DataFrame, ratings: DataFrame, version: str) -> DataFrame:
    """Observations without a rating of their present line by this version."""
    known = ratings.where(F.col("version") == version).select("id", "line")
    return observations.join(known, ["id", "line"], "left_anti")


def rated(observations: DataFrame, ratings: DataFrame) -> DataFrame:
    """``observations`` with the ratings of their present line; unrated reach and surprise are one half."""
    joined = observations.join(ratings.select("id", "line", "reach", "surprise", "directive", "sensitivity"), ["id", "line"], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in (("reach", 0.5), ("surprise", 0.5), ("directive", 0.0), ("sensitivity", 0.0))})


def batch_problems(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """(rule, id): ids of a batch that were not answered, answered twice, or not asked."""
    missing = asked.join(answers, "id", "left_anti").select(F.lit("missing").alias("rule"), "id")
    twice = answers.groupBy("id").count().where("count > 1").select(F.lit("twice").alias("rule"), "id")
    unknown = answers.join(asked, "id", "left_anti").select(F.lit("unknown").alias("rule"), "id").distinct()
    return missing.union(twice).union(unknown)


def extraction_problems(extractions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(seq, problem) of extractions (seq, digest, observations) against their chunks (seq, id).

    Candidate ids are unique and not empty, with a page and evidence among the chunks;
    brackets around evidence are ignored.
    """
    blank = extractions.where(_blank("digest")).select("seq", F.lit("digest must not be empty").alias("problem"))
    each = extractions.select("seq", F.explode("observations").alias("o")).select("seq", "o.*")
    ids = each.groupBy("seq", "candidate_id").count().where("count > 1 or trim(candidate_id) = ''").select("seq", F.lit("candidate ids must be unique").alias("problem"))
    paged = each.where(F.size("pages") == 0).select("seq", F.lit("needs a page").alias("problem"))
    evidence = each.select("seq", F.explode_outer("evidence").alias("e")).select("seq", F.regexp_replace("e", r"[\[\]]", "").alias("id"))
    unknown = evidence.join(chunks.select("seq", "id"), ["seq", "id"], "left_anti").select("seq", F.lit("evidence is no chunk").alias("problem"))
    category = each.select("seq", F.explode("pages").alias("p")).where(~F.col("p.category").isin(*CATEGORIES)).select("seq", F.lit("unknown category").alias("problem"))
    return blank.union(ids).union(paged).union(unknown).union(category).distinct()
