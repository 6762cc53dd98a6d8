"""Active days of users as bits of months.

A user is one row: an array with an entry for each month that has events, whose
bits are the days. First days, "active N days later" and month cohorts are looked
up in it, so user-days are neither shuffled nor sorted nor held in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.filters import EventFilters, in_scope
from eventloom.functions.keys import month_number, month_start

# What a user-month keeps; as SQL, like the measures of ``functions.measures``.
PER_MONTH = {
    "days": "bit_or(shiftleft(1L, day(event_date)))",
    "chosen": "max(chosen)",
    "first_chosen": "min(event_date) FILTER (WHERE chosen)",
}


def month_columns() -> list[Column]:
    return [F.expr(f"{text} AS `{name}`") for name, text in PER_MONTH.items()]


def marked(events: DataFrame, filters: EventFilters | None) -> DataFrame:
    """All events with ``month`` and ``chosen``, whether the filter holds; never null."""
    scope = F.coalesce(in_scope(filters), F.lit(False))
    return events.withColumns({"month": month_number(F.col("event_date")), "chosen": scope})


def user_months(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    """One row ``(user_id, month, days, chosen, first_chosen)`` per user and month; events without a date are a month of their own."""
    known = marked(events, filters).where(F.col("user_id").isNotNull())
    return known.groupBy("user_id", "month").agg(*month_columns())


def user_calendars(months: DataFrame) -> DataFrame:
    """``(user_id, first_date, months)`` of users with a chosen event.

    ``first_date`` is the first chosen day, ``months`` the sorted months of all events.
    """
    users = months.groupBy("user_id").agg(
        F.max("chosen").alias("chosen"),
        F.min("first_chosen").alias("first_date"),
        F.array_sort(F.collect_list(F.struct("month", "days"))).alias("months"),
    )
    return users.where("chosen").select("user_id", "first_date", "months")


def active_after(day: int) -> Column:
    """Whether a user has an event exactly ``day`` days after the first date."""
    target = F.date_add("first_date", day)
    return F.exists("months", lambda m: (m["month"] == month_number(target)) & (F.getbit(m["days"], F.day(target)) == 1))


def active_dates() -> Column:
    """All days of a user, in order; a null for events without a date."""
    every = F.sequence(F.lit(1), F.lit(31))

    def dates(m: Column) -> Column:
        listed = F.transform(
            F.filter(every, lambda d: F.getbit(m["days"], d) == 1), lambda d: F.date_add(month_start(m["month"]), d - 1)
        )
        return F.when(m["days"].isNull(), F.array(F.lit(None).cast("date"))).otherwise(listed)

    return F.flatten(F.transform("months", dates))
