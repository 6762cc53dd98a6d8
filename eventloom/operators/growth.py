"""Period-over-period growth of grouped series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.filters import EventFilters, select
from eventloom.functions.keys import monday_week_key, month_key
from eventloom.functions.measures import money, summarise, user_rollup
from eventloom.functions.numbers import half_even, ratio
from eventloom.operators.activity import daily_average


def growth_pct(value: str, over) -> Column:
    """Percent change against the row before; null on the first row or a zero base."""
    return (ratio(F.col(value), F.lag(value).over(over)) - 1) * 100


def _growth(events: DataFrame, filters: EventFilters | None, key: Column, name: str) -> DataFrame:
    series = summarise(select(events, filters).withColumn(name, key), name).select(
        name, F.col("users").alias("active_users"), "revenue"
    )
    order = Window.orderBy(name)  # one row per period
    return series.select(
        "*",
        half_even(growth_pct("active_users", order), 2).alias("user_growth_pct"),
        half_even(growth_pct("revenue", order), 2).alias("revenue_growth_pct"),
    ).orderBy(name)


def monthly_growth(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    return _growth(events, filters, month_key(F.col("event_date")), "year_month")


def weekly_growth(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    return _growth(events, filters, monday_week_key(F.col("event_date")), "year_week")


def campaign_growth(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    """Month-over-month revenue growth within each campaign."""
    series = (
        select(events, filters)
        .groupBy("campaign", month_key(F.col("event_date")).alias("year_month"))
        .agg(F.sum(money()).cast("double").alias("revenue"))
    )
    return campaign_growth_of(series)


def campaign_growth_of(series: DataFrame) -> DataFrame:
    """Growth of ``(campaign, year_month, revenue)`` rows."""
    order = Window.partitionBy("campaign").orderBy("year_month")  # one row per month
    growth = half_even(growth_pct("revenue", order), 2).alias("revenue_growth_pct")
    return series.select("*", growth).orderBy("campaign", "year_month")


def top_campaign_growth(events: DataFrame, filters: EventFilters | None = None, n: int = 5) -> DataFrame:
    """Growth rows of the ``n`` campaigns with the largest total revenue."""
    growth = campaign_growth(events, filters)
    leaders = (
        growth.where(F.col("campaign").isNotNull())
        .groupBy("campaign")
        .agg(F.sum(F.col("revenue").cast("decimal(28,2)")).alias("total"))
        .orderBy(F.desc("total"), "campaign")
        .limit(n)
    )
    return growth.join(leaders.select("campaign"), "campaign", "left_semi").orderBy("campaign", "year_month")


def monthly_growth_table(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    """Revenue and mean daily users per month, with the growth of both."""
    dated = select(events, filters).withColumn("month", month_key(F.col("event_date")))
    monthly = (
        user_rollup(dated.where(F.col("month").isNotNull()), "month")
        .groupBy("month")
        .agg(F.sum("revenue").cast("double").alias("revenue"), daily_average().alias("avg_dau"))
    )
    order = Window.orderBy("month")  # one row per month
    return monthly.select(
        "*",
        growth_pct("revenue", order).alias("revenue_growth_pct"),
        growth_pct("avg_dau", order).alias("dau_growth_pct"),
    ).orderBy("month")
