"""Days, weeks of a month, months and years as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ("day", "week", "month", "year")


def parsed_date(text: Column) -> Column:
    """A timestamp from a date or an RFC 3339 time in one text field; null for neither."""
    date = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    time = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"), text.try_cast("timestamp"))
    return F.coalesce(date, time)


def day_in_zone(text: Column, zone: str = "UTC") -> Column:
    """Ten characters pass as they are; a time becomes the date in the zone."""
    local = F.from_utc_timestamp(parsed_date(text), zone).cast("date").cast("string")
    return F.when(F.length(text) == 10, text).otherwise(local)


def period_ids(day: Column) -> dict[str, Column]:
    """The ids of a day and of the periods around it; days after the 28th join the fourth week."""
    month = F.date_format(day, "yyyy-MM")
    week = F.least(F.lit(4), F.floor((F.dayofmonth(day) + 6) / 7)).cast("string")
    return {
        "day": F.concat(F.lit("day:"), F.date_format(day, "yyyy-MM-dd")),
        "week": F.concat(F.lit("week:"), month, F.lit("-"), week),
        "month": F.concat(F.lit("month:"), month),
        "year": F.concat(F.lit("year:"), F.date_format(day, "yyyy")),
    }


def parent_period(period: Column) -> Column:
    """day to week, week to month, month to year; null for a year or anything else."""
    body = F.element_at(F.split(period, ":"), 2)
    day = F.try_to_timestamp(body, F.lit("yyyy-MM-dd")).cast("date")
    return (
        F.when(period.startswith("day:"), period_ids(day)["week"])
        .when(period.startswith("week:"), F.concat(F.lit("month:"), F.left(body, F.lit(7))))
        .when(period.startswith("month:"), F.concat(F.lit("year:"), F.left(body, F.lit(4))))
    )


def period_bounds(period: Column) -> tuple[Column, Column]:
    """First and last day; the fourth week runs to the month's end; nulls if malformed."""
    kind, body = F.element_at(F.split(period, ":"), 1), F.element_at(F.split(period, ":"), 2)
    month = F.try_to_timestamp(F.left(body, F.lit(7)), F.lit("yyyy-MM")).cast("date")
    week = F.regexp_extract(body, r"^\d{4}-\d{2}-([1-4])$", 1).try_cast("int")
    day = F.try_to_timestamp(body, F.lit("yyyy-MM-dd")).cast("date")
    year = F.try_to_timestamp(body, F.lit("yyyy")).cast("date")
    start = F.when(kind == "day", day).when(kind == "week", F.date_add(month, (week - 1) * 7)).when(kind == "month", month).when(kind == "year", year)
    stop = (
        F.when(kind == "day", day)
        .when(kind == "week", F.when(week == 4, F.last_day(month)).otherwise(F.date_add(month, week * 7 - 1)))
        .when(kind == "month", F.last_day(month))
        .when(kind == "year", F.last_day(F.add_months(year, 11)))
    )
    return start, stop


def shown_date(day: Column, now: Column) -> Column:
    """``2 Jan``, with the year where it is not this one."""
    return F.when(F.year(day) == F.year(now), F.date_format(day, "d MMM")).otherwise(F.date_format(day, "d MMM yyyy"))
