"""Calendar roll-ups: periods, which of them are due, and covers of the past."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.calendar import LEVELS, period_bounds, period_ids

#: How many observations a month's and a year's input names.
TOP = {"month": 10, "year": 20}


def periods_of(df: DataFrame, day: str) -> DataFrame:
    """``df`` once for each of the four periods its day lies in: level and period."""
    ids = period_ids(F.col(day))
    pairs = F.array(*(F.struct(F.lit(i).alias("level"), ids[n].alias("period")) for i, n in enumerate(LEVELS)))
    return df.withColumn("__p", F.explode(pairs)).select(*df.columns, F.element_at(F.array(*map(F.lit, LEVELS)), F.col("__p.level") + 1).alias("level"), F.col("__p.period").alias("period"))


def rolled_up(df: DataFrame, day: str, weight: str, seq: str) -> DataFrame:
    """(level, period, n_sources, weight, last_seq) for all four levels, days first."""
    days = df.groupBy(F.col(day).alias("__day")).agg(F.count("*").alias("n"), F.sum(weight).alias("w"), F.max(seq).alias("s"))
    spread = periods_of(days, "__day")
    return spread.groupBy("level", "period").agg(F.sum("n").alias("n_sources"), F.sum("w").alias("weight"), F.max("s").alias("last_seq"))


def due(periods: DataFrame, today: Column, pending_days: DataFrame, built: DataFrame, parents: DataFrame) -> DataFrame:
    """(period): not built, over before today, no pending day inside, all child periods built.

    ``periods`` and ``built`` have period, ``pending_days`` day, ``parents`` child and
    period.
    """
    start, stop = period_bounds(F.col("period"))
    bounded = periods.select("period", start.alias("start"), stop.alias("stop")).where(F.col("stop") < today)
    pending = periods_of(pending_days.select("day").distinct(), "day").select("period").distinct()
    missing = parents.join(built.select(F.col("period").alias("child")), "child", "left_anti").select("period").distinct()
    return bounded.join(built, "period", "left_anti").join(pending, "period", "left_anti").join(missing, "period", "left_anti").select("period")


def cover(days: DataFrame, built: DataFrame, before: Column) -> DataFrame:
    """(period): the coarsest built periods that tell of the days before ``before``.

    Up to a year for years before the last, a month before the previous month, a week
    before the week, of a month, that comes before the one of ``before``, else the day.
    """
    day = F.col("day")
    month = F.trunc(before, "month")
    week_start = lambda x: period_bounds(period_ids(x)["week"])[0]
    last_week = week_start(F.date_sub(week_start(before), 1))
    allowed = F.when(F.year(day) < F.year(before) - 1, 3).when(day < F.add_months(month, -1), 2).when(day < last_week, 1).otherwise(0)
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level")) - 1
    spread = periods_of(days.where(day < before).select("day", allowed.alias("allowed")), "day").withColumn("rank", rank).where("rank <= allowed")
    known = spread.join(built.select("period"), "period", "left_semi")
    return known.groupBy("day").agg(F.max_by("period", "rank").alias("period")).select("period").distinct()


def top_of_period(df: DataFrame, day: str, weight: str, key: str) -> DataFrame:
    """The rows of largest weight in each month and year, ties by key; null weighs nothing."""
    spread = periods_of(df, day).where(F.col("level").isin(*TOP))
    rank = F.row_number().over(Window.partitionBy("period").orderBy(F.desc(F.coalesce(weight, F.lit(0.0))), key))
    most = F.when(F.col("level") == "month", TOP["month"]).otherwise(TOP["year"])
    return spread.withColumn("rank", rank).where(F.col("rank") <= most)


def previous_day(days: DataFrame, value: str) -> DataFrame:
    """``days`` (day, value) with previous, the value of the calendar day before, if it has one."""
    earlier = days.select(F.date_add("day", 1).alias("day"), F.col(value).alias("previous"))
    return days.join(earlier, "day", "left")


def pending_days(entries: DataFrame, states: DataFrame) -> DataFrame:
    """(day): days of entries (seq, day) of which one at least is not done in states (seq, status)."""
    done = states.where("status = 'done'").select("seq")
    return entries.join(done, "seq", "left_anti").select("day").distinct()


def done_through(states: DataFrame) -> DataFrame:
    """(seq): the last finished entry of states (seq, status), 0 without one."""
    return states.agg(F.coalesce(F.max(F.when(F.col("status") == "done", F.col("seq"))), F.lit(0)).cast("long").alias("seq"))


def build_input(entries: DataFrame, extractions: DataFrame, states: DataFrame, observations: DataFrame, ratings: DataFrame) -> DataFrame:
    """(level, period, n_sources, reach, last_seq, n_observations, sources): what a period's view is made from.

    ``entries`` has seq and day, ``extractions`` seq and digest, ``states`` seq and
    status, ``observations`` seq, id and line, ``ratings`` id, line and reach. Sources
    are finished extractions; a day names them. Observations count with the reach of
    their present line, unrated ones with none.
    """
    finished = extractions.join(states.where("status = 'done'").select("seq"), "seq", "left_semi").select("seq", F.lit(1).alias("told"))
    rated = observations.join(ratings.select("id", "line", "reach"), ["id", "line"], "left")
    told = rated.groupBy("seq").agg(F.sum(F.coalesce("reach", F.lit(0.0))).alias("reach"), F.count("*").alias("n"))
    each = entries.join(finished, "seq", "left").join(told, "seq", "left")
    spread = periods_of(each.select("seq", "day", "told", "reach", "n"), "day")
    named = F.when(F.col("level") == "day", F.when(F.col("told") == 1, F.concat(F.lit("src:"), F.col("seq").cast("string"))))
    rolled = spread.groupBy("level", "period").agg(
        F.coalesce(F.sum("told"), F.lit(0)).alias("n_sources"),
        F.coalesce(F.sum("reach"), F.lit(0.0)).alias("reach"),
        F.max("seq").alias("last_seq"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_observations"),
        F.sort_array(F.collect_list(named)).alias("sources"),
    )
    return rolled


def valid_compositions(views: DataFrame, observations: DataFrame) -> DataFrame:
    """``views`` (id, kind, seq, input_ids) with valid: no input is missing or was gone after the view's seq.

    Other kinds than compositions are always valid.
    """
    gone = F.when(F.col("replaced_by").isNotNull() | F.col("forgotten").isNotNull(), F.col("seq")).otherwise(-1)
    known = observations.select(F.col("id").alias("input"), gone.alias("gone"))
    inputs = views.where("kind = 'composition'").select("id", "seq", F.explode("input_ids").alias("input"))
    bad = inputs.join(known, "input", "left").where("gone is null or gone > seq").select("id").distinct().withColumn("bad", F.lit(True))
    return views.join(bad, "id", "left").withColumn("valid", F.col("bad").isNull()).drop("bad")


def stored_composition(views: DataFrame, observations: DataFrame, scope: str, exclude: DataFrame | None = None) -> DataFrame:
    """The newest valid composition of a scope with a text, as at most one row; none if it rests on an excluded id."""
    valid = valid_compositions(views.where((F.col("kind") == "composition") & (F.col("scope") == scope) & (F.trim(F.coalesce("text", F.lit(""))) != "")), observations)
    newest = valid.where("valid").orderBy(F.desc("seq"), "id").limit(1)
    if exclude is None:
        return newest
    inputs = newest.select("id", F.explode("input_ids").alias("input")).join(exclude.select(F.col("id").alias("input")), "input", "left_semi")
    return newest.join(inputs.select("id").distinct(), "id", "left_anti")


def composition_due(views: DataFrame, changes: DataFrame, least: int = 20) -> DataFrame:
    """(scope): scopes whose view is missing, invalid or blank, or behind ``least`` changes.

    ``views`` has scope, seq, text and valid; ``changes`` scope and seq.
    """
    scopes = changes.select("scope").union(views.select("scope")).distinct()
    behind = changes.join(views.select("scope", F.col("seq").alias("at")), "scope").where("seq > at").groupBy("scope").agg(F.count("*").alias("n"))
    known = scopes.join(views.select("scope", "text", "valid"), "scope", "left").join(behind, "scope", "left")
    return known.where(F.col("text").isNull() | (F.trim("text") == "") | ~F.col("valid") | (F.coalesce("n", F.lit(0)) >= least)).select("scope")
