"""The warehouse report queries: newest first, ISO weeks, events instead of users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.keys import iso_week_number, month_key
from eventloom.functions.measures import is_purchase, summarise
from eventloom.functions.numbers import ratio
from eventloom.operators.activity import active_users


def dau_latest_first(events: DataFrame) -> DataFrame:
    return active_users(events, F.col("event_date"), "event_date", "dau").orderBy(F.desc("event_date"))


def wau_latest_first(events: DataFrame) -> DataFrame:
    week = iso_week_number(F.col("event_timestamp").cast("date"))
    return active_users(events, week, "year_week", "wau").orderBy(F.desc("year_week"))


def mau_latest_first(events: DataFrame) -> DataFrame:
    return active_users(events, month_key(F.col("event_date")), "year_month", "mau").orderBy(F.desc("year_month"))


def monthly_revenue_latest_first(events: DataFrame) -> DataFrame:
    monthly = summarise(events.withColumn("year_month", month_key(F.col("event_date"))), "year_month")
    return monthly.select(
        "year_month", F.col("revenue").alias("total_revenue"), F.col("users").alias("total_users"),
        "paying_users", "arpu", "arppu",
    ).orderBy(F.desc("year_month"))


def event_funnel(events: DataFrame) -> DataFrame:
    """Events (not users) per stage in one row, with step percentages."""

    def count(stage: str, name: str):
        return F.count_if(F.col("event_name") == stage).alias(name)

    counts = events.agg(
        count("App Open", "app_opens"),
        count("Search", "searches"),
        count("Add to Cart", "add_to_carts"),
        F.count_if(is_purchase()).alias("purchases"),
    )

    def percent(part: str, whole: str):
        return F.round(ratio(100.0 * F.col(part), F.col(whole)), 2)

    return counts.select(
        "*",
        percent("searches", "app_opens").alias("open_to_search_pct"),
        percent("add_to_carts", "searches").alias("search_to_cart_pct"),
        percent("purchases", "add_to_carts").alias("cart_to_purchase_pct"),
        percent("purchases", "app_opens").alias("overall_conversion_pct"),
    )


def top_channels(events: DataFrame, n: int = 10) -> DataFrame:
    """Traffic source and campaign pairs by revenue; the mean is per event."""
    pairs = summarise(events, "traffic_source", "campaign").select(
        "traffic_source",
        "campaign",
        F.col("users").alias("total_users"),
        F.col("revenue").alias("total_revenue"),
        F.round(ratio(F.col("revenue"), F.col("events")), 2).alias("avg_revenue_per_user"),
    )
    return pairs.orderBy(F.desc("total_revenue"), "traffic_source", "campaign").limit(n)
