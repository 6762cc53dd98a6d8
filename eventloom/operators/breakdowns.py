"""Measures per dimension, and top-n lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.filters import EventFilters, in_scope, select
from eventloom.functions.measures import money, summarise

BY_REVENUE = "revenue"


def _ranked(
    events: DataFrame, filters: EventFilters | None, keys: list[str], columns: list[str], order: str = BY_REVENUE
) -> DataFrame:
    """``columns`` per ``keys``, largest ``order`` first; ties in key order."""
    table = summarise(select(events, filters), *keys, sessions="sessions" in columns)
    return table.select(*keys, *columns).orderBy(F.desc(order), *keys)


def revenue_by_country(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    return _ranked(events, filters, ["country"], ["revenue", "users", "arpu"])


def revenue_by_device(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    return _ranked(events, filters, ["device_type"], ["revenue", "users", "arpu"])


def revenue_by_campaign(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    return _ranked(events, filters, ["campaign"], ["revenue", "users", "arpu"])


def revenue_by_traffic_source(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    return _ranked(events, filters, ["traffic_source"], ["revenue", "users"])


def revenue_by_subscription(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    return _ranked(events, filters, ["subscription"], ["revenue", "users", "arpu"])


def returning_vs_new_users(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    return _ranked(events, filters, ["user_type"], ["users", "events", "revenue"], order="users")


def top_countries(events: DataFrame, filters: EventFilters | None = None, n: int = 10) -> DataFrame:
    return _ranked(events, filters, ["country"], ["revenue", "users"]).limit(n)


def top_cities(events: DataFrame, filters: EventFilters | None = None, n: int = 10) -> DataFrame:
    return _ranked(events, filters, ["city", "country"], ["revenue", "users"]).limit(n)


def top_campaigns(events: DataFrame, filters: EventFilters | None = None, n: int = 10) -> DataFrame:
    return _ranked(events, filters, ["campaign"], ["revenue", "users", "arpu"]).limit(n)


def traffic_source_analysis(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    columns = ["users", "sessions", "converters", "conversion_rate_pct", "revenue"]
    return _ranked(events, filters, ["traffic_source"], columns)


def subscription_analysis(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    table = _ranked(events, filters, ["subscription"], ["users", "revenue", "arpu", "avg_session_duration"])
    return table.withColumn("avg_session_duration", F.round("avg_session_duration", 1))


def device_breakdown(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    return _ranked(events, filters, ["device_type"], ["users", "sessions", "revenue"])


def os_breakdown(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    return _ranked(events, filters, ["os"], ["users", "revenue"])


def app_version_breakdown(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    return _ranked(events, filters, ["app_version"], ["users", "revenue"], order="users")


def conversion_rate_by_country(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    columns = ["users", "converters", "conversion_rate_pct"]
    return _ranked(events, filters, ["country"], columns, order="conversion_rate_pct")


def campaign_efficiency(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    return (
        summarise(select(events, filters), "campaign")
        .where(F.col("users") > 0)
        .select("campaign", "users", "revenue", F.col("arpu").alias("revenue_per_user"))
        .orderBy(F.desc("revenue_per_user"), "campaign")
    )


def campaign_device_performance(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    return _ranked(events, filters, ["campaign", "device_type"], ["revenue", "users"])


def campaign_comparison(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    return _ranked(events, filters, ["campaign"], ["users", "revenue", "arpu", "conversion_rate_pct"])


def country_device_matrix(events: DataFrame, filters: EventFilters | None = None, n: int = 10) -> DataFrame:
    """Revenue per country and device for the ``n`` countries with most revenue.

    The filter picks the countries; their revenue is then taken over all events.
    A null country can take a place among the ``n`` but has no rows.
    """
    chosen = in_scope(filters)
    cells = events.groupBy("country", "device_type").agg(
        F.sum(money()).alias("revenue"),
        F.sum(F.when(chosen, money())).alias("chosen_revenue"),
        F.count_if(chosen).alias("chosen_events"),
    )
    # A country carries its cells along, one per device type, so that events are read once.
    countries = cells.groupBy("country").agg(
        F.sum("chosen_revenue").alias("chosen_revenue"),
        F.sum("chosen_events").alias("chosen_events"),
        F.collect_list(F.struct("device_type", F.col("revenue").cast("double").alias("revenue"))).alias("cells"),
    )
    leaders = countries.where(F.col("chosen_events") > 0).orderBy(F.desc("chosen_revenue"), "country").limit(n)
    return leaders.where(F.col("country").isNotNull()).select("country", F.inline("cells"))
