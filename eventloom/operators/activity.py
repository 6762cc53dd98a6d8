"""Active users, event volume and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.filters import EventFilters, select
from eventloom.functions.keys import monday_week_key, month_key
from eventloom.functions.measures import summarise, user_rollup
from eventloom.functions.numbers import ratio


def active_users(events: DataFrame, key: Column, key_name: str, users_name: str) -> DataFrame:
    """Distinct users per value of ``key``."""
    keyed = events.select(key.alias(key_name), "user_id")
    return keyed.groupBy(key_name).agg(F.count_distinct("user_id").alias(users_name)).orderBy(key_name)


def dau(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    return active_users(select(events, filters), F.col("event_date"), "date", "dau")


def wau(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    return active_users(select(events, filters), monday_week_key(F.col("event_date")), "year_week", "wau")


def mau(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    return active_users(select(events, filters), month_key(F.col("event_date")), "year_month", "mau")


def daily_average() -> Column:
    """Over user-months: mean distinct users per active day.

    The user-days are the bits of all users, the calendar days the bits of any.
    """
    user_days = F.sum(F.when(F.col("user_id").isNotNull(), F.bit_count("days")))
    return ratio(F.coalesce(user_days, F.lit(0)), F.bit_count(F.bit_or("days")))


def stickiness_dau_mau(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    """Mean daily over monthly active users. The filter holds for both."""
    monthly = select(events, filters).withColumn("year_month", month_key(F.col("event_date")))
    return (
        user_rollup(monthly, "year_month")
        .groupBy("year_month")
        .agg(daily_average().alias("mean_dau"), F.count("user_id").alias("mau"))
        .where(F.col("year_month").isNotNull())
        .select(
            "year_month",
            F.round("mean_dau", 1).alias("avg_dau"),
            "mau",
            F.round(ratio(100.0 * F.col("mean_dau"), F.col("mau")), 2).alias("stickiness_pct"),
        )
        .orderBy("year_month")
    )


def daily_event_volume(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    return (
        summarise(select(events, filters), "event_date")
        .select(F.col("event_date").alias("date"), F.col("events").alias("event_count"), F.col("users").alias("active_users"))
        .orderBy("date")
    )


def event_frequency(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    return (
        summarise(select(events, filters), "event_name")
        .select("event_name", F.col("events").alias("event_count"), "users")
        .orderBy(F.desc("event_count"), "event_name")
    )


def level_progression(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    """Users seen at each level value; a user counts at every level reached."""
    return summarise(select(events, filters), "level_completed").select("level_completed", "users").orderBy("level_completed")


def retention_by_day_bucket(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    return summarise(select(events, filters), "retention_day").select("retention_day", "users").orderBy("retention_day")


def new_user_acquisition_trend(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    """Users per first seen date."""
    return (
        user_rollup(select(events, filters))
        .groupBy(F.col("first_date").alias("date"))
        .agg(F.count(F.lit(1)).alias("new_users"))
        .orderBy("date")
    )


def session_duration_stats(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    return select(events, filters).agg(
        F.count_distinct("session_id").alias("total_sessions"),
        F.round(F.avg("session_duration"), 1).alias("avg_duration"),
        F.min("session_duration").alias("min_duration"),
        F.max("session_duration").alias("max_duration"),
    )


def sessions_per_user(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    per_user = select(events, filters).groupBy("user_id").agg(F.count_distinct("session_id").alias("sessions"))
    return per_user.agg(
        F.count(F.lit(1)).alias("total_users"),
        F.round(F.avg("sessions"), 2).alias("avg_sessions_per_user"),
        F.max("sessions").alias("max_sessions_per_user"),
    )
