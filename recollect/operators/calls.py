"""Calls of a model inside tasks, and ratings in waves.

A request is a row; tasks call an injected client, check the answer, and let the client
repair it once. A memo in a folder that all executors mount keeps each answer under the
request's number and text as soon as it has passed, so a task that runs again, after a
lost executor or a failed neighbour, does not call again.

Ratings are asked for in numbered batches. The first goes alone and later ones go several
at once, a wave, each with a calibration sample of all ratings before its wave. A wave's
ratings are written before the next one begins, so a run that fails goes on with the wave
that failed.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.operators.reports import calibration_sample
from recollect.operators.tables import kept, numbered
from recollect.operators.validation import stale_ratings

#: (request, what was wrong with the answer before) -> answer; (request, answer) -> what is wrong with it.
Client = Callable[[str, str | None], str]
Check = Callable[[str, str], str | None]
#: Fixed value: observations of a batch.
BATCH = 50
RATING = "id string, line string, version string, reach double, surprise double, directive double, sensitivity double, number long"
_SCORES = ("reach", "surprise", "directive", "sensitivity")


class FolderMemo:
    """Answers as files, each written under another name first, so that no reader sees half of one."""

    def __init__(self, path: str):
        self.path = path

    def get(self, key: str) -> str | None:
        try:
            return Path(self.path, key).read_text(encoding="utf-8")
        except FileNotFoundError:
            return None

    def put(self, key: str, answer: str) -> None:
        os.makedirs(self.path, exist_ok=True)
        own = Path(self.path, f".{key}-{uuid.uuid4().hex}")
        own.write_text(answer, encoding="utf-8")
        own.rename(Path(self.path, key))


def _answer(number: int, request: str, client: Client, check: Check, memo: FolderMemo | None) -> str:
    key = hashlib.sha256(f"{number}\x00{request}".encode()).hexdigest()
    known = memo.get(key) if memo is not None else None
    if known is not None:
        return known
    answer = client(request, None)
    if problem := check(request, answer):
        answer = client(request, problem)
        if problem := check(request, answer):
            raise ValueError(f"request {number}: {problem}")
    if memo is not None:
        memo.put(key, answer)
    return answer


def answered(requests: DataFrame, client: Client, check: Check, memo: FolderMemo | None = None) -> DataFrame:
    """(number, answer) of ``requests`` (number, request); an answer that is still wrong after its repair raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, request in zip(batch["number"].to_pylist(), batch["request"].to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([_answer(number, request, client, check, memo)])], names=["number", "answer"])

    return requests.select(F.col("number").cast("long").alias("number"), "request").mapInArrow(run, "number long, answer string")


def ratings_problem(request: str, answer: str) -> str | None:
    """Whether each asked id is rated once, with all scores between 0 and 1."""
    asked = {o["id"] for o in json.loads(request)["observations"]}
    try:
        told = json.loads(answer)["ratings"]
        ids = [r["id"] for r in told]
        fits = all(0 <= r[s] <= 1 for r in told for s in _SCORES)
    except (ValueError, TypeError, KeyError) as error:
        return f"not of the asked shape: {error!r}"
    if len(ids) != len(set(ids)) or set(ids) - asked:
        return "unknown or repeated ids"
    if len(ids) != len(asked):
        return f"rated {len(ids)} of {len(asked)} observations; rate every id exactly once"
    return None if fits else "scores are between 0 and 1"


def _table(df: DataFrame, path: str) -> DataFrame:
    try:
        return df.sparkSession.read.schema(RATING).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return df.sparkSession.createDataFrame([], RATING)


def rated_in_waves(observations: DataFrame, client: Client, path: str, version: str, concurrency: int = 4, memo: FolderMemo | None = None) -> DataFrame:
    """The ratings in the folder ``path``, after those of ``observations`` (id, line) that have none of this version.

    Observations are numbered by id, ``BATCH`` to a request; waves follow each other, as
    each is calibrated against the ones before.
    """
    spark = observations.sparkSession
    pending = kept(numbered(stale_ratings(observations.select("id", "line"), _table(observations, path), version), "n", "id"))
    # Of an id that is there already with another line the new rating follows the old one.
    batch = F.floor((F.col("n") - 1) / BATCH)
    waves = kept(pending.withColumn("batch", batch).withColumn("wave", F.when(F.col("batch") == 0, 0).otherwise(1 + F.floor((F.col("batch") - 1) / concurrency))))
    last = waves.agg(F.max("wave")).first()[0]
    before = _table(observations, path).agg(F.coalesce(F.max("number") + 1, F.lit(0))).first()[0]
    for wave in range(0 if last is None else last + 1):
        now = _table(observations, path).where(F.col("version") == version)
        # At most a dozen rows.
        sample = calibration_sample(now.select(F.col("number").alias("id"), "line", *_SCORES)).orderBy(F.desc("id")).collect()
        examples = json.dumps([{"line": r["line"], "ratings": {s: r[s] for s in _SCORES}} for r in sample], ensure_ascii=False)
        own = waves.where(F.col("wave") == wave)
        lists = own.groupBy("batch").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("n", "id", "line"))), lambda x: F.struct(x["id"].alias("id"), x["line"].alias("line")))).alias("told"))
        requests = lists.select(F.col("batch").alias("number"), F.concat(F.lit('{"calibration_examples": '), F.lit(examples), F.lit(', "observations": '), "told", F.lit("}")).alias("request"))
        # A request is a task, as its time is the model's.
        answers = answered(requests.repartition(concurrency, "number"), client, ratings_problem, memo)
        shape = "struct<ratings array<struct<id string, reach double, surprise double, directive double, sensitivity double>>>"
        each = answers.select(F.explode(F.from_json("answer", shape)["ratings"]).alias("r")).select("r.*")
        told = each.join(own.select("id", "line", "n"), "id").select("id", "line", F.lit(version).alias("version"), *_SCORES, (F.col("n") - 1 + before).alias("number"))
        told.write.mode("append").parquet(path)
    return _table(observations, path)
