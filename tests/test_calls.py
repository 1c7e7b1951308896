"""Ratings in waves with an injected client: samples, repairs, failures and repeated tasks."""

import json
import os
from pathlib import Path

import pytest

from recollect.operators import calls
from recollect.operators.reports import calibration_sample


def client_of(folder: str, fail_at: str | None = None):
    """Rates by the id's number; the first answer of every third batch lacks an id, and one batch fails once."""

    def client(request: str, problem: str | None) -> str:
        asked = json.loads(request)
        first = asked["observations"][0]["id"]
        name = Path(folder, f"{first}-{'repair' if problem else 'call'}-{len(os.listdir(folder))}")
        name.write_text(request)
        if first == fail_at and not Path(folder, "failed").exists():
            Path(folder, "failed").write_text("")
            raise RuntimeError("the model is down")
        told = [{"id": o["id"], "reach": int(o["id"][1:]) % 100 / 100, "surprise": 0.5, "directive": int(o["id"][1:]) % 7 / 7, "sensitivity": 0.0} for o in asked["observations"]]
        return json.dumps({"ratings": told[1:] if problem is None and int(first[1:]) // 50 % 3 == 2 else told})

    return client


def test_waves(spark, tmp_path):
    log, memo = tmp_path / "log", calls.FolderMemo(str(tmp_path / "memo"))
    log.mkdir()
    obs = spark.createDataFrame([(f"o{i:04}", f'line {i} "quoted"') for i in range(330)], "id string, line string")
    client = client_of(str(log), "o0250")
    run = lambda: calls.rated_in_waves(obs, client, str(tmp_path / "ratings"), "v1", 2, memo)
    with pytest.raises(Exception, match="the model is down"):
        run()
    done = spark.read.schema(calls.RATING).parquet(str(tmp_path / "ratings"))
    n_done = done.count()
    assert n_done in (250,), "waves of one, two and two batches are written"
    table = run()
    assert table.count() == 330 and table.select("id").distinct().count() == 330
    asked = [json.loads(p.read_text()) for p in log.iterdir() if p.name != "failed" and "-call-" in p.name]
    firsts = sorted(x["observations"][0]["id"] for x in asked)
    # Only the wave that failed is asked again, and its first batch goes alone.
    assert firsts.count("o0250") == 2 and all(firsts.count(f"o{i:04}") == 1 for i in range(0, 250, 50)) and 1 <= firsts.count("o0300") <= 2
    assert sorted(p.name.split("-")[0] for p in log.iterdir() if "-repair-" in p.name) == ["o0100", "o0250"]
    by_first = {x["observations"][0]["id"]: x["calibration_examples"] for x in asked}
    assert by_first["o0000"] == []
    before = table.where("number < 50").selectExpr("number as id", "line", "reach", "surprise", "directive", "sensitivity")
    want = {r["line"] for r in calibration_sample(before).collect()}
    assert {x["line"] for x in by_first["o0050"]} == {x["line"] for x in by_first["o0100"]} == want
    assert {x["line"] for x in by_first["o0150"]} != want
    assert run().count() == 330, "nothing is left"


def test_a_repeated_task_does_not_call_again(tmp_path):
    memo, told = calls.FolderMemo(str(tmp_path / "memo")), []

    def client(request, problem):
        told.append(problem)
        return "right" if problem else "wrong"

    check = lambda request, answer: None if answer == "right" else "try again"
    assert [calls._answer(3, "x", client, check, memo) for _ in range(2)] == ["right", "right"] and told == [None, "try again"]
    assert calls._answer(4, "x", client, check, memo) == "right" and len(told) == 4


def test_an_answer_that_stays_wrong_raises():
    assert calls.ratings_problem('{"observations": [{"id": "a"}]}', "[]").startswith("not of the asked shape")
    assert "unknown" in calls.ratings_problem('{"observations": [{"id": "a"}]}', '{"ratings": [{"id": "b", "reach": 0, "surprise": 0, "directive": 0, "sensitivity": 0}]}')
    assert calls.ratings_problem('{"observations": [{"id": "a"}]}', '{"ratings": [{"id": "a", "reach": 2, "surprise": 0, "directive": 0, "sensitivity": 0}]}') == "scores are between 0 and 1"
    with pytest.raises(ValueError, match="request 7: always"):
        calls._answer(7, "x", lambda request, problem: "y", lambda request, answer: "always", None)
