"""Measures of an event table, in two levels.

``user_rollup`` first reduces events to one row per group and user, with sums
and yes/no flags. ``summarise`` then counts users by flag and adds up the sums.
Each level aggregates on the map side before it shuffles, so one user or one
group may hold any share of the rows, and several "distinct users who ..."
measures cost one shuffle instead of a copy of the input each. The optimizer
drops the measures a query does not select.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.schema import FUNNEL_STAGES, PURCHASE, RETURNING


def money(column: str = "revenue") -> Column:
    """Amounts are added as decimals, so no order of rows changes a digit."""
    return F.col(column).cast("decimal(18,2)")


def is_purchase() -> Column:
    return F.col("event_name") == PURCHASE


# Written as SQL: one call per measure into the JVM instead of one per operator.
PER_USER = {
    "events": "count(1)",
    "named_events": "count(event_name)",
    "revenue": "sum(cast(revenue AS decimal(18,2)))",
    "has_revenue": "max(revenue > 0)",
    "has_purchase": f"max(event_name = '{PURCHASE}')",
    "has_payment": f"max(event_name = '{PURCHASE}' AND purchase_amount > 0)",
    "purchases": f"count_if(event_name = '{PURCHASE}')",
    "payments": f"count_if(event_name = '{PURCHASE}' AND purchase_amount > 0)",
    "paid": f"sum(cast(purchase_amount AS decimal(18,2))) FILTER (WHERE event_name = '{PURCHASE}' AND purchase_amount > 0)",
    "duration": "sum(session_duration)",
    "timed_events": "count(session_duration)",
    "min_duration": "min(session_duration)",
    "max_duration": "max(session_duration)",
    "first_date": "min(event_date)",
    "last_date": "max(event_date)",
    # kind of the first event in time (0 none, 1 before RETURNING, 2 that, 3 after it), below the time in one number,
    # so that it is a plain minimum; events without a time come last
    "first_kind": "min(coalesce(unix_micros(cast(event_timestamp AS timestamp)), 500000000000000000L) * 4 + CASE WHEN user_type IS NULL"
    f" THEN 0 WHEN user_type < '{RETURNING}' THEN 1 WHEN user_type = '{RETURNING}' THEN 2 ELSE 3 END)",
    # one bit per day of the month
    "days": "bit_or(shiftleft(1L, day(event_date)))",
    **{f"stage_{i}": f"max(event_name = '{stage}')" for i, stage in enumerate(FUNNEL_STAGES)},
}

PER_GROUP = {
    "users": "count(user_id)",
    "paying_users": "count_if(user_id IS NOT NULL AND has_revenue)",
    "converters": "count_if(user_id IS NOT NULL AND has_purchase)",
    "payers": "count_if(user_id IS NOT NULL AND has_payment)",
    "events": "coalesce(sum(events), 0)",
    "named_events": "coalesce(sum(named_events), 0)",
    "revenue": "cast(sum(revenue) AS double)",
    "purchases": "coalesce(sum(purchases), 0)",
    "payments": "coalesce(sum(payments), 0)",
    "paid": "cast(sum(paid) AS double)",
    "duration": "sum(duration)",
    "timed_events": "sum(timed_events)",
    "min_duration": "min(min_duration)",
    "max_duration": "max(max_duration)",
}

RATES = {
    "arpu": "round(try_divide(revenue, users), 2)",
    "arppu": "round(try_divide(revenue, paying_users), 2)",
    "conversion_rate_pct": "round(try_divide(100.0D * converters, users), 2)",
    "avg_session_duration": "try_divide(cast(duration AS double), timed_events)",
}


def sql_columns(expressions: dict[str, str]) -> list[Column]:
    return [F.expr(f"{text} AS `{name}`") for name, text in expressions.items()]


def user_rollup(events: DataFrame, *keys: str) -> DataFrame:
    """One row per ``keys`` and user.

    ``days`` has meaning where the keys contain the month: it holds the days of
    that month with an event, so active days need no row of their own.
    """
    return events.groupBy(*keys, "user_id").agg(*sql_columns(PER_USER))


def summarise(events: DataFrame, *keys: str, sessions: bool = False) -> DataFrame:
    """One row per ``keys`` with every measure; ``sessions`` adds distinct sessions.

    Without keys the result is one row, also for no events.
    """
    totals = user_rollup(events, *keys).groupBy(*keys).agg(*sql_columns(PER_GROUP))
    if sessions:
        counted = events.groupBy(*keys).agg(F.count_distinct("session_id").alias("sessions"))
        totals = join_on(totals, counted, keys) if keys else totals.select("*", counted.scalar().alias("sessions"))
    return totals.select("*", *sql_columns(RATES))


def join_on(left: DataFrame, right: DataFrame, keys: tuple[str, ...] | list[str]) -> DataFrame:
    """Inner join on keys where null matches null, as in grouping."""
    renamed = right.withColumnsRenamed({key: f"_{key}" for key in keys})
    same = reduce(Column.__and__, [F.col(key).eqNullSafe(F.col(f"_{key}")) for key in keys])
    return left.join(renamed, same).drop(*[f"_{key}" for key in keys])


def one_row(df: DataFrame) -> Column:
    """A one-row frame as a struct value: a scalar subquery, run once."""
    return df.select(F.struct("*")).scalar()
