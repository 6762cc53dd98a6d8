"""Revenue over time, per user, per session and per purchase."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.filters import EventFilters, select
from eventloom.functions.keys import month_key
from eventloom.functions.measures import is_purchase, money, summarise
from eventloom.functions.numbers import ratio


def revenue_trend(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    return (
        select(events, filters)
        .groupBy(F.col("event_date").alias("date"))
        .agg(F.sum(money()).cast("double").alias("revenue"))
        .orderBy("date")
    )


def monthly_revenue(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    monthly = select(events, filters).withColumn("year_month", month_key(F.col("event_date")))
    return (
        summarise(monthly, "year_month")
        .select(
            "year_month", F.col("revenue").alias("total_revenue"), F.col("users").alias("total_users"),
            "paying_users", "arpu", "arppu",
        )
        .orderBy("year_month")
    )


def arpu_overall(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    return summarise(select(events, filters)).select(
        F.col("revenue").alias("total_revenue"), F.col("users").alias("total_users"), "paying_users", "arpu", "arppu"
    )


def revenue_per_session(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    totals = select(events, filters).agg(
        F.sum(money()).cast("double").alias("total_revenue"),
        F.count_distinct("session_id").alias("total_sessions"),
    )
    per_session = ratio(F.col("total_revenue"), F.col("total_sessions"))
    return totals.withColumn("revenue_per_session", F.round(per_session, 4))


def purchase_frequency(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    """Purchase events per user who has any."""
    per_user = select(events, filters).where(is_purchase()).groupBy("user_id").agg(F.count(F.lit(1)).alias("purchases"))
    return per_user.agg(
        F.count(F.lit(1)).alias("paying_users"),
        F.round(F.avg("purchases"), 2).alias("avg_purchase_frequency"),
        F.max("purchases").alias("max_purchase_frequency"),
    )


def purchase_amount_distribution(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    amount = F.col("purchase_amount")
    bucket = (
        F.when(amount <= 0, "No purchase")
        .when(amount < 10, "0-10")
        .when(amount < 25, "10-25")
        .when(amount < 50, "25-50")
        .when(amount < 100, "50-100")
        .otherwise("100+")
    )
    return (
        select(events, filters)
        .groupBy(bucket.alias("bucket"))
        .agg(F.count(F.lit(1)).alias("events"), F.sum(money("purchase_amount")).cast("double").alias("total_amount"))
    )


def kpi_snapshot(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    return summarise(select(events, filters), sessions=True).select(
        F.col("users").alias("total_users"),
        F.col("sessions").alias("total_sessions"),
        F.col("events").alias("total_events"),
        F.col("revenue").alias("total_revenue"),
        "arpu",
        "arppu",
        "conversion_rate_pct",
        F.round("avg_session_duration", 1).alias("avg_session_duration"),
    )
