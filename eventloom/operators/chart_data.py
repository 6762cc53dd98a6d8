"""Data behind the charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.filters import EventFilters, select
from eventloom.functions.measures import money
from eventloom.operators.activity import dau
from eventloom.operators.retention import users_by_first_value


def dau_smoothed(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    """Daily users with a centred mean over three rows."""
    around = Window.orderBy("date").rowsBetween(-1, 1)  # one row per day
    daily = dau(events, filters).where(F.col("date").isNotNull()).withColumnRenamed("dau", "active_users")
    return daily.withColumn("smoothed", F.avg("active_users").over(around)).orderBy("date")


def revenue_by(events: DataFrame, dimension: str, ascending: bool = False, earning_only: bool = False) -> DataFrame:
    rows = (
        events.where(F.col(dimension).isNotNull())
        .groupBy(dimension)
        .agg(F.sum(money()).cast("double").alias("revenue"))
    )
    if earning_only:
        rows = rows.where(F.col("revenue") > 0)
    return rows.orderBy(F.asc("revenue") if ascending else F.desc("revenue"), dimension)


def events_by(events: DataFrame, dimension: str, filters: EventFilters | None = None) -> DataFrame:
    rows = select(events, filters).where(F.col(dimension).isNotNull())
    return rows.groupBy(dimension).agg(F.count(F.lit(1)).alias("events")).orderBy(F.desc("events"), dimension)


def subscription_users(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    return users_by_first_value(select(events, filters), "subscription")


def user_type_users(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    return users_by_first_value(select(events, filters), "user_type")


def retention_day_users(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    return users_by_first_value(select(events, filters), "retention_day").orderBy("retention_day")
