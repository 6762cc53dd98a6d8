"""Retention, first-seen dates and acquisition cohorts.

A filter decides who is a user and when they were first seen; later activity is
taken from all events. One reduction of the events carries both views, so the
event table is neither joined to itself nor read twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.filters import EventFilters, in_scope, select
from eventloom.functions.keys import month_key, month_number, month_start, week_span
from eventloom.functions.measures import money, summarise
from eventloom.functions.numbers import exact_round, fixed, ratio
from eventloom.operators.active_days import active_after, active_dates, user_calendars, user_months
from eventloom.schema import COHORT_DAYS
from eventloom.wording import COHORT_TEXT


def retention_overall_rate(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    """Share of users with any event after their first seen date."""
    first_seen = F.min(F.when(in_scope(filters), F.col("event_date")))
    per_user = events.groupBy("user_id").agg(
        first_seen.alias("first_date"),
        F.max("event_date").alias("last_date"),
        F.max(in_scope(filters)).alias("chosen"),
    )
    back = F.col("user_id").isNotNull() & (F.col("last_date") > F.col("first_date"))
    return (
        per_user.where("chosen")
        .agg(F.count(F.lit(1)).alias("total_users"), F.count_if(back).alias("returning_users"))
        .withColumn(
            "retention_rate_pct", F.round(ratio(100.0 * F.col("returning_users"), F.col("total_users")), 2)
        )
    )


def user_first_and_activity_dates(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    """Distinct ``(user_id, cohort_date, event_date)`` of users inside the filter."""
    users = user_calendars(user_months(events, filters))
    return users.select("user_id", F.col("first_date").alias("cohort_date"), F.explode(active_dates()).alias("event_date"))


def cohort_table(
    events: DataFrame, filters: EventFilters | None = None, days: Sequence[int] = COHORT_DAYS
) -> DataFrame:
    """Percent of each monthly cohort active exactly N days after first seen."""
    return cohorts_of(user_calendars(user_months(events, filters)), days)


def cohorts_of(users: DataFrame, days: Sequence[int] = COHORT_DAYS) -> DataFrame:
    """The cohort table of user calendars (``active_days``)."""
    sized = users.groupBy(month_key(F.col("first_date")).alias("cohort_month")).agg(
        F.count(F.lit(1)).alias("cohort_size"), *[F.count_if(active_after(day)).alias(f"kept_{day}") for day in days]
    )
    rates = [
        exact_round(ratio(100.0 * F.col(f"kept_{day}"), F.col("cohort_size")), 2).alias(f"Day {day}") for day in days
    ]
    return sized.where(F.col("cohort_month").isNotNull()).select("cohort_month", "cohort_size", *rates).orderBy("cohort_month")


def cohort_cells(cohorts: DataFrame) -> DataFrame:
    """The cohort table as rows ``(cohort_month, milestone, retention_pct)``."""
    milestones = [name for name in cohorts.columns if name.startswith("Day ")]
    return cohorts.unpivot(["cohort_month"], milestones, "milestone", "retention_pct")


def cohort_insights(cohorts: DataFrame) -> DataFrame:
    """Mean Day 1, mean Day 30 and the best Day 30 cohort (the first of equals)."""
    facts = cohorts.agg(
        F.count(F.lit(1)).alias("cohorts"),
        F.avg("Day 1").alias("day_1"),
        F.avg("Day 30").alias("day_30"),
        F.min(F.struct((-F.col("Day 30")).alias("rank"), "cohort_month")).alias("best"),
    )
    lines = F.array(
        F.format_string(COHORT_TEXT["day_1"], fixed(F.col("day_1"), 1)),
        F.format_string(COHORT_TEXT["day_30"], fixed(F.col("day_30"), 1)),
        F.format_string(COHORT_TEXT["best"], F.col("best.cohort_month"), fixed(-F.col("best.rank"), 1)),
    )
    chosen = F.when(F.col("cohorts") == 0, F.array(F.lit(COHORT_TEXT["none"]))).otherwise(lines)
    return facts.select(F.posexplode(chosen).alias("at", "text")).select((F.col("at") + 1).alias("position"), "text")


def cohort_activity_by_month(events: DataFrame) -> DataFrame:
    """Active users per month of first event and month of activity."""
    users = user_calendars(user_months(events))
    cells = users.select(
        month_number(F.col("first_date")).alias("cohort"), F.explode(F.col("months.month")).alias("activity")
    ).groupBy("cohort", "activity").agg(F.count(F.lit(1)).alias("active_users"))
    return cells.select(
        month_key(month_start(F.col("cohort"))).alias("cohort_month"),
        month_key(month_start(F.col("activity"))).alias("activity_month"),
        "active_users",
    ).orderBy("cohort_month", "activity_month")


def retention_heatmap(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    """Distinct users per week and retention day: a row for each week and day that occur, 0 where they do not together.

    Days are rows and not columns, so no job has to find them first and none is left out.
    """
    known = select(events, filters).where(F.col("retention_day").isNotNull() & F.col("event_date").isNotNull())
    cells = summarise(known.withColumn("cohort_week", week_span(F.col("event_date"))), "cohort_week", "retention_day")
    cells = cells.select("cohort_week", "retention_day", "users")
    days = cells.agg(F.collect_set("retention_day")).scalar()  # as many as there are distinct days
    weeks = cells.select("cohort_week").distinct()
    every = weeks.select("cohort_week", F.explode(days).alias("retention_day"))
    return (
        every.join(cells, ["cohort_week", "retention_day"], "left")
        .na.fill(0, ["users"])
        .orderBy("cohort_week", "retention_day")
    )


def users_by_first_value(events: DataFrame, column: str) -> DataFrame:
    """Users per value of ``column`` on their first event.

    First is by time; of several values at the same moment the smallest counts.
    """
    starts = (
        events.where(F.col("user_id").isNotNull())
        .groupBy("user_id", column)
        .agg(F.min("event_timestamp").alias("since"))
        .groupBy("user_id")
        .agg(F.min(F.struct("since", column)).alias("start"))
    )
    counts = starts.groupBy(F.col(f"start.{column}").alias(column)).agg(F.count(F.lit(1)).alias("users"))
    return counts.where(F.col(column).isNotNull()).orderBy(F.desc("users"), column)


def user_level_aggregate(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    """Last date, distinct sessions and revenue per user."""
    return select(events, filters).groupBy("user_id").agg(
        F.max("event_date").alias("last_event_date"),
        F.count_distinct("session_id").alias("frequency"),
        F.sum(money()).cast("double").alias("monetary"),
    )
