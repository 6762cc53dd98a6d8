"""Conversion funnels. Stages are counted one by one, in no order of time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.filters import EventFilters, select
from eventloom.functions.numbers import half_even, ratio
from eventloom.schema import FUNNEL_STAGES


def stage_users(events: DataFrame, stages: Sequence[str] = FUNNEL_STAGES) -> DataFrame:
    """Rows ``(position, stage, users)``; a stage without events has 0 users.

    Events become one row of flags per user before they are shuffled.
    """
    staged = events.where(F.col("event_name").isin(*stages) & F.col("user_id").isNotNull())
    reached = staged.groupBy("user_id").agg(
        *[F.max(F.col("event_name") == stage).alias(f"stage_{i}") for i, stage in enumerate(stages)]
    )
    counts = reached.agg(*[F.count_if(f"stage_{i}").alias(f"stage_{i}") for i in range(len(stages))])
    listed = F.array(
        *[F.struct(F.lit(stage).alias("stage"), F.col(f"stage_{i}").alias("users")) for i, stage in enumerate(stages)]
    )
    return counts.select(F.posexplode(listed).alias("position", "at")).select("position", "at.stage", "at.users")


def funnel(
    events: DataFrame, filters: EventFilters | None = None, stages: Sequence[str] = FUNNEL_STAGES
) -> DataFrame:
    """Users per stage, as percent of the first and of the previous stage."""
    path = Window.orderBy("position")  # one row per stage
    users = F.col("users")
    first = F.first("users").over(path)
    base = F.when(first == 0, 1).otherwise(first)
    previous = F.lag("users").over(path)
    change = F.when((users == 0) & (previous == 0), 0.0).otherwise(ratio(users, previous) - 1)
    return (
        stage_users(select(events, filters), stages)
        .select(
            "position",
            "stage",
            "users",
            half_even(ratio(users, base) * 100, 2).alias("conversion_from_first_pct"),
            F.when(previous.isNull(), 100.0).otherwise(half_even(change * 100 + 100, 2)).alias("conversion_from_prev_pct"),
        )
        .orderBy("position")
        .drop("position")
    )
