"""Column functions on literals worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from recollect.functions import calendar, names, scoring, text


def value(spark, column, **fields):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in fields.items())) if fields else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "want"), [("", 0), ("a", 2), ("a b c", 4), (" a b\n\tc d ", 6), (None, 0)])
def test_token_estimate(spark, given, want):
    assert value(spark, text.token_estimate(F.lit(given).cast("string"))) == want


def test_normalized(spark):
    assert value(spark, text.normalized(F.lit("  Été-2024: Ça_va?"))) == "été 2024 ça va"


def test_truncation(spark):
    assert value(spark, text.middle_truncated(F.lit("a" * 10), 10)) == "a" * 10
    cut = value(spark, text.middle_truncated(F.lit("abcdefghijklmnopqrst"), 14))
    assert cut == "abc\n...\nopqrst"
    assert value(spark, text.utf16_length(F.lit("a🤦"))) == 3
    wide = value(spark, text.middle_truncated(F.lit("🤦" * 40), 25))
    assert "\n...\n" in wide and wide.replace("\n...\n", "").strip("🤦") == ""


def test_cleaned(spark):
    assert value(spark, text.cleaned(F.lit(" a\x00b\r\n\r\n\r\n\r\nc "))) == "ab\n\nc"


def test_citations(spark):
    given = F.lit("One [a1, b2] two [b2,c3]. Three [ ].")
    assert value(spark, text.citations(given)) == ["a1", "b2", "c3"]
    allowed = F.array(F.lit("a1"), F.lit("c3"))
    assert value(spark, text.citations_cleaned(given, allowed)) == "One [a1] two [c3]. Three."
    assert value(spark, text.dropped_share(given, allowed)) == pytest.approx(1 / 3)
    assert value(spark, text.without_brackets(given)) == "One two. Three."


def test_lines(spark):
    assert value(spark, text.numbered_lines(F.lit("a\nb"))) == ["1\ta", "2\tb"]
    assert value(spark, text.line_slice(F.lit("a\nb\nc"), F.lit(2), F.lit(3))) == "b\nc"
    assert value(spark, text.line_slice(F.lit("a\nb\nc"), F.lit(2), F.lit(4))) is None
    assert value(spark, text.speakers(F.lit("Ann: hi\nBob : yo\nAnn: x\nno label"))) == ["Ann", "Bob"]
    assert value(spark, text.standing_ids(F.lit("see 0a1b2c3d and 0a1b2c3de"))) == ["0a1b2c3d"]


def test_content(spark):
    assert value(spark, text.flat_content(F.lit('"plain"'))) == "plain"
    blocks = '[{"type":"text","text":"a"},{"type":"thinking","thinking":"no"},{"type":"output_text","text":"b"}]'
    assert value(spark, text.flat_content(F.lit(blocks))) == "a\nb"
    assert value(spark, text.flat_content(F.lit('{"x":1}'))) == ""


@pytest.mark.parametrize(("path", "want"), [("/a/My Project!/", "my-project"), ("/x/9lives", None), ("a", None), ("/ab", "ab"), ("/ü", None)])
def test_home_slug(spark, path, want):
    assert value(spark, text.home_slug(F.lit(path))) == want


def test_rendering(spark):
    line = text.rendered_line(F.lit("0a1b2c3d"), F.lit(3), F.lit(True), F.lit("Says so."), F.lit(4), F.lit("12 Sep"))
    assert value(spark, line) == "- 0a1b2c3d [3+] Says so. (4; 12 Sep)"
    assert value(spark, text.observation_text(F.lit("l"), F.lit(None).cast("string"))) == "l"
    assert value(spark, text.without_keys(F.lit('{"weight":"1","line":"x"}'), "weight")) == {"line": "x"}


@pytest.mark.parametrize(("day", "week"), [("2024-02-01", 1), ("2024-02-07", 1), ("2024-02-08", 2), ("2024-02-28", 4), ("2024-02-29", 4), ("2024-01-31", 4)])
def test_weeks(spark, day, week):
    ids = calendar.period_ids(F.to_date(F.lit(day)))
    assert value(spark, ids["week"]) == f"week:{day[:7]}-{week}"
    assert value(spark, calendar.parent_period(ids["day"])) == f"week:{day[:7]}-{week}"


@pytest.mark.parametrize(("period", "start", "stop"), [("week:2024-02-4", "2024-02-22", "2024-02-29"), ("month:2023-12", "2023-12-01", "2023-12-31"), ("year:2023", "2023-01-01", "2023-12-31"), ("week:2024-02-5", None, None), ("day:x", None, None)])
def test_bounds(spark, period, start, stop):
    a, b = calendar.period_bounds(F.lit(period))
    assert (value(spark, a.cast("string")), value(spark, b.cast("string"))) == (start, stop)


def test_dates(spark):
    assert value(spark, calendar.parsed_date(F.lit("2024-02-30"))) is None
    assert value(spark, calendar.parsed_date(F.lit("2024-02-03T04:05:06+01:00"))) == dt.datetime(2024, 2, 3, 3, 5, 6)
    assert value(spark, calendar.day_in_zone(F.lit("2024-02-03T23:30:00Z"), "Europe/Paris")) == "2024-02-04"
    now = F.to_date(F.lit("2024-05-05"))
    assert value(spark, calendar.shown_date(F.to_date(F.lit("2024-01-02")), now)) == "2 Jan"
    assert value(spark, calendar.shown_date(F.to_date(F.lit("2023-01-02")), now)) == "2 Jan 2023"


def test_formulas(spark):
    assert value(spark, scoring.formula("-1 * reach")) == 0.0
    assert value(spark, scoring.formula("log(1 + sources) * 2", {"sources": F.lit(0)})) == 0.0
    assert value(spark, scoring.score("page")) == pytest.approx(0.5 * (1 + 0.1 * 1.791759469 + 0.05 * 1.098612289))
    for bad in ("reach +", "__import__('os')", "reach.x", "exp(reach)", "unknown", "reach if 1 else 2", "'a'"):
        with pytest.raises(ValueError):
            scoring.formula(bad)


def test_scores(spark):
    now, day = (F.lit(x).cast("timestamp") for x in ("2024-01-11", "2024-01-01"))
    assert value(spark, scoring.freshness(day, now, F.lit(10.0))) == 0.5
    assert value(spark, scoring.freshness(now, day, F.lit(10.0))) == 1.0
    assert value(spark, scoring.freshness(day, now, F.lit(None).cast("double"))) == 1.0
    assert [value(spark, scoring.bucket(F.lit(x))) for x in (0.6, 0.3, 0.29)] == [3, 2, 1]
    assert value(spark, scoring.source_prior(F.lit("nothing"))) == 0.0
    cost = scoring.call_cost({k: F.lit(v) for k, v in (("input", 2.0), ("cached", 1.0), ("output", 8.0))}, {k: F.lit(v) for k, v in (("input", 1e6), ("cached", 5e5), ("output", 1e5))}, F.lit(0.5))
    assert value(spark, cost) == pytest.approx(0.5 * (1.0 + 0.5 + 0.8))
    first, rest = scoring.budgets(F.lit(1001), 8, 4)
    assert (value(spark, first), value(spark, rest)) == (667, 334)


@pytest.mark.parametrize(("a", "b", "want"), [("ab", "ab", 0.0), ("billing", "Billing", 1.0), ("kitten", "sitting", 1 - 3 / 7), ("project-x", "projects and plans", 0.8)])
def test_name_score(spark, a, b, want):
    assert value(spark, names.name_score(F.lit(a), F.lit(b))) == pytest.approx(want)


@pytest.mark.parametrize(("glob", "path", "want"), [("**/x.md", "x.md", True), ("**/x.md", "a/b/x.md", True), ("a/*/c", "a/b/c", True), ("a/*/c", "a/b/d/c", False), ("a/**", "a/b/c", True), ("a/?.md", "a/bc.md", False), ("*.md", "a/b.md", False)])
def test_globs(spark, glob, path, want):
    assert value(spark, names.glob_match(F.lit(path), glob)) is want
