"""Calendar keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_key(day: Column) -> Column:
    """``2025-01``."""
    return F.date_format(day, "yyyy-MM")


def monday_week_key(day: Column) -> Column:
    """``2025-W03``: weeks start on Monday, days before the first Monday are week 00."""
    week = F.floor((F.dayofyear(day) + 6 - F.weekday(day)) / 7)
    return F.concat(F.year(day).cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def iso_week_number(day: Column) -> Column:
    """``202503``: ISO year and week as one number."""
    return F.extract(F.lit("YEAROFWEEK"), day) * 100 + F.weekofyear(day)


def week_span(day: Column) -> Column:
    """``2025-01-13/2025-01-19``: Monday and Sunday of the week."""
    monday = F.trunc(day, "week")
    return F.concat_ws("/", monday.cast("string"), F.date_add(monday, 6).cast("string"))


def weekday_name(day: Column) -> Column:
    return F.date_format(day, "EEEE")


def month_number(day: Column) -> Column:
    """Months since year 0, so that months follow each other by 1."""
    return F.year(day) * 12 + F.month(day) - 1


def month_start(number: Column) -> Column:
    """The first day of the month with that number."""
    return F.make_date(F.floor(number / 12).cast("int"), (number % 12 + 1).cast("int"), F.lit(1))
