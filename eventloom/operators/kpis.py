"""Headline KPIs, as one row, as metric rows, and against the previous period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.filters import EventFilters, select
from eventloom.functions.keys import month_key
from eventloom.functions.measures import one_row, sql_columns, user_rollup
from eventloom.functions.numbers import (
    change_pct,
    currency_label,
    number_label,
    percent_label,
    ratio_or,
)
from eventloom.functions.quantiles import quantiles
from eventloom.operators.day_cube import WHOLE, DayCube
from eventloom.operators.revenue import kpi_snapshot
from eventloom.operators.segments import leader, segment_totals
from eventloom.schema import FUNNEL_STAGES
from eventloom.wording import CARD_LABELS

# KPIs compared between periods.
COMPARED = (
    "total_users", "dau", "mau", "revenue", "arpu", "conversion_rate", "avg_purchase_value",
    "paying_users", "total_sessions", "total_purchases",
)


SUMS = ("events", "revenue", "purchases", "payments", "paid", "duration", "timed_events")
STAGE_FLAGS = [f"stage_{i}" for i in range(len(FUNNEL_STAGES))]
FLAGS = ["has_payment", *STAGE_FLAGS]

# user-months -> users, and months -> one row for each period -> rates
USER_TOTALS = {
    "by_user": "grouping(month) = 1",
    "active_days": "sum(bit_count(days))",
    "active_months": "count(in_month)",
    "month_days": "bit_count(bit_or(days))",
    "first_kind": "min(first_kind)",
    **{name: f"max({name})" for name in FLAGS},
    **{name: f"sum({name})" for name in SUMS},
}
OF_USER = "by_user AND user_id IS NOT NULL"
TOTALS = {
    "users": f"count_if({OF_USER})",
    "user_days": f"sum(active_days) FILTER (WHERE {OF_USER})",
    "user_months": f"sum(active_months) FILTER (WHERE {OF_USER})",
    "returning": f"count_if({OF_USER} AND pmod(first_kind, 4) = 2)",
    "calendar_days": "sum(month_days) FILTER (WHERE NOT by_user)",
    "calendar_months": "count(month) FILTER (WHERE NOT by_user)",
    **{name: f"count_if({OF_USER} AND {name})" for name in FLAGS},
    **{name: f"sum({name}) FILTER (WHERE by_user)" for name in SUMS},
}
RATES = {
    "users": "users",
    "payers": "has_payment",
    "events": "events",
    "sessions": "sessions",
    "returning": "returning",
    "revenue": "cast(revenue AS double)",
    "payments": "payments",
    "dau": "coalesce(try_divide(cast(user_days AS double), calendar_days), 0D)",
    "mau": "coalesce(try_divide(cast(user_months AS double), calendar_months), 0D)",
    "arpu": "coalesce(try_divide(cast(revenue AS double), users), 0D)",
    "arppu": "coalesce(try_divide(cast(revenue AS double), has_payment), 0D)",
    "conversion": "coalesce(try_divide(100.0D * has_payment, users), 0D)",
    "purchase_rate": "coalesce(try_divide(100.0D * purchases, events), 0D)",
    "avg_purchase": "coalesce(try_divide(cast(paid AS double), payments), 0D)",
    "avg_duration": "coalesce(try_divide(cast(duration AS double), timed_events), 0D)",
    "stages": f"array({', '.join(STAGE_FLAGS)})",
}
NOW, EARLIER = WHOLE, "earlier"


def period_totals(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    """A row ``(period, totals, rates, users per funnel stage)`` for now and, where there is one, the earlier period.

    Both periods, all user counts, the days and months with events and the first
    type of each user come from one pass over the events: they are reduced to
    user-months, with the days a user was active as bits of one number, and
    those to users and to months. Sessions are counted in another pass, which
    is left out where they are not asked for. A period without events is zero.
    """
    earlier = filters.previous_period() if filters else None
    name = F.when(filters.predicate() if filters else F.lit(True), NOW)
    if earlier is not None:
        name = name.when(earlier.predicate(), EARLIER)
    periods = [NOW] if earlier is None else [NOW, EARLIER]
    tagged = events.withColumn("period", name).where(F.col("period").isNotNull())

    months = user_rollup(tagged.withColumn("month", month_key(F.col("event_date"))), "period", "month")
    months = months.withColumn("in_month", F.col("month"))
    sets = [[F.col("period"), F.col("user_id")], [F.col("period"), F.col("month")]]
    users = months.groupingSets(sets, "period", "user_id", "month").agg(*sql_columns(USER_TOTALS))
    totals = users.groupBy("period").agg(*sql_columns(TOTALS))
    sessions = tagged.groupBy("period").agg(F.count_distinct("session_id").alias("sessions"))

    def of(period: str, column: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("period") == period, F.col(column))), F.lit(0))

    counted = sessions.agg(*[of(p, "sessions").alias(p) for p in periods])
    listed = [F.struct(F.lit(p).alias("period"), *[of(p, c).alias(c) for c in TOTALS]) for p in periods]
    rows = totals.agg(F.array(*listed).alias("rows")).select(F.explode("rows").alias("row")).select("row.*")
    own = F.lit(0)
    for p in periods:
        own = F.when(F.col("period") == p, counted.select(p).scalar()).otherwise(own)
    return rows.withColumn("sessions", own).select("period", *sql_columns(RATES))


def cube_totals(cube: DayCube, periods: tuple[str, ...] = (NOW,)) -> DataFrame:
    """``period_totals`` read from a day cube of these periods."""
    return cube.period_totals(periods).select("period", *sql_columns(RATES))


def cube_of(events: DataFrame, filters: EventFilters | None = None) -> DayCube:
    """The day cube of the chosen events and, where there is one, of the period before."""
    periods = {NOW: filters.predicate() if filters else F.lit(True)}
    if filters and (earlier := filters.previous_period()) is not None:
        periods[EARLIER] = earlier.predicate()
    return DayCube.of(events, periods)


def activity_totals(events: DataFrame) -> DataFrame:
    """One row of totals, rates and users per funnel stage, zero for no events."""
    return period_totals(events).drop("period")


def batch_kpis(events: DataFrame) -> DataFrame:
    """One row with the scalar KPIs of the batch report, zero for no events."""
    return batch_kpis_with_stages(events).drop("stages")


def batch_kpis_with_stages(events: DataFrame) -> DataFrame:
    return _batch_named(activity_totals(events).select("*", median_duration(events).scalar().alias("median")))


def batch_kpis_of(cube: DayCube) -> DataFrame:
    """``batch_kpis_with_stages`` read from a day cube."""
    totals = cube_totals(cube).where(F.col("period") == NOW).select("*", cube.median_duration().scalar().alias("median"))
    return _batch_named(totals)


def _batch_named(totals: DataFrame) -> DataFrame:
    return totals.selectExpr(
        "users AS total_users",
        "events AS total_events",
        "sessions AS total_sessions",
        "dau AS avg_dau",
        "mau AS avg_mau",
        "revenue AS total_revenue",
        "arpu",
        "arppu",
        "avg_purchase AS avg_purchase_value",
        "payers AS paying_users",
        "avg_duration AS avg_session_duration",
        "median AS median_session_duration",
        "conversion AS conversion_rate_pct",
        "purchase_rate AS purchase_rate_pct",
        "coalesce(try_divide(100.0D * returning, users), 0D) AS returning_user_pct",
        "stages",
    )


def median_duration(events: DataFrame) -> DataFrame:
    return quantiles(events, "session_duration", {"median": 0.5})


def dashboard_kpis(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    """One row with the top-line KPIs, all zero for no events."""
    return kpis_with_stages(select(events, filters)).drop("stages", "returning")


def kpis_with_stages(events: DataFrame) -> DataFrame:
    """The top-line KPIs, the users per funnel stage as an array, and the users that were returning at first."""
    return _named(activity_totals(events))


def kpis_and_earlier(events: DataFrame, filters: EventFilters | None, earlier: Sequence[str] = COMPARED) -> DataFrame:
    """``kpis_with_stages`` of now, and ``earlier``: a struct of KPIs before, all null without a period or events.

    Column by column, so that what a caller does not use is not computed; the struct has only the KPIs named.
    """
    return _beside(period_totals(events, filters), earlier)


def cube_kpis_and_earlier(cube: DayCube, earlier: Sequence[str] = COMPARED) -> DataFrame:
    """The same read from a day cube of both periods."""
    return _beside(cube_totals(cube, (NOW, EARLIER)), earlier)


def _beside(totals: DataFrame, earlier: Sequence[str]) -> DataFrame:
    rows = _named(totals, "period")
    names = [c for c in rows.columns if c != "period"]
    now, before = F.col("period") == NOW, (F.col("period") == EARLIER) & (F.col("total_events") > 0)
    both = rows.agg(
        *[F.first(F.when(now, F.col(c)), ignorenulls=True).alias(c) for c in names],
        *[F.first(F.when(before, F.col(c)), ignorenulls=True).alias(f"{EARLIER}_{c}") for c in earlier],
    )
    return both.select(*names, F.struct(*[F.col(f"{EARLIER}_{c}").alias(c) for c in earlier]).alias(EARLIER))


def _named(totals: DataFrame, *keys: str) -> DataFrame:
    return totals.selectExpr(
        *keys,
        "users AS total_users",
        "dau",
        "mau",
        "revenue",
        "arpu",
        "conversion AS conversion_rate",
        "avg_purchase AS avg_purchase_value",
        "payers AS paying_users",
        "sessions AS total_sessions",
        "payments AS total_purchases",
        "events AS total_events",
        "avg_duration AS avg_session_duration",
        "stages",
        "returning",
    )


def advanced_kpis(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    """One row: stickiness, efficiency and the leading country and device."""
    chosen = select(events, filters)
    return advanced_from(kpis_with_stages(chosen), chosen)


def advanced_from(kpis: DataFrame, chosen: DataFrame) -> DataFrame:
    leaders = segment_totals(chosen, ["country", "device_type"]).agg(
        leader("country", "revenue").alias("country"), leader("device_type", "revenue").alias("device")
    )
    return advanced_of(kpis.select("*", one_row(leaders).alias("top")))


def advanced_of(facts: DataFrame) -> DataFrame:
    """The advanced KPIs from KPIs and leaders that are known."""
    return facts.select(
        ratio_or(100.0 * F.col("dau"), F.col("mau")).alias("stickiness"),
        "avg_session_duration",
        ratio_or(100.0 * F.col("returning"), F.col("total_users")).alias("returning_pct"),
        "paying_users",
        ratio_or(F.col("revenue"), F.col("total_sessions")).alias("revenue_per_session"),
        ratio_or(F.col("revenue"), F.col("total_purchases")).alias("revenue_per_purchase"),
        _name_if_earning("top.country").alias("top_country"),
        _name_if_earning("top.device").alias("top_device"),
    )


def _name_if_earning(spot: str):
    return F.when(F.col(f"{spot}.low") < 0, F.col(f"{spot}.segment")).otherwise(F.lit("N/A"))


def metric_rows(kpis: DataFrame) -> DataFrame:
    """A one-row KPI frame as rows ``(metric, value)``."""
    numbers = kpis.select(*[F.col(name).cast("double").alias(name) for name in kpis.columns])
    return numbers.unpivot([], kpis.columns, "metric", "value")


def period_comparison(events: DataFrame, filters: EventFilters) -> DataFrame:
    """Each KPI now and in the previous period, with percent change and direction.

    Without a date range, or without events in the earlier period, previous and
    change are null.
    """
    both = kpis_and_earlier(events, filters)
    pairs = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric"),
                F.col(name).cast("double").alias("current"),
                F.col(f"earlier.{name}").cast("double").alias("previous"),
            )
            for name in COMPARED
        ]
    )
    change = change_pct(F.col("current"), F.col("previous"))
    return (
        both.select(F.inline(pairs))
        .withColumn("change_pct", change)
        .withColumn("direction", F.when(change > 0.05, "up").when(change < -0.05, "down").when(change.isNotNull(), "flat"))
        .orderBy("metric")
    )


def filtered_summary_metrics(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    """Eleven rows ``(metric, value)`` of the filtered events."""
    chosen = select(events, filters)
    median = F.coalesce(median_duration(chosen).scalar(), F.lit(0.0))
    kpis = dashboard_kpis(chosen).select(
        "total_users",
        F.col("dau").alias("avg_dau"),
        F.col("mau").alias("avg_mau"),
        F.col("revenue").alias("total_revenue"),
        "arpu",
        F.col("conversion_rate").alias("conversion_rate_pct"),
        "avg_purchase_value",
        "avg_session_duration",
        median.alias("median_session_duration"),
        "total_events",
        "total_sessions",
    )
    return metric_rows(kpis)


REVENUE_SERIES = {"country": "revenue_per_country", "device_type": "revenue_per_device", "campaign": "revenue_per_campaign"}


def kpi_series(events: DataFrame) -> DataFrame:
    """Rows ``(metric, key, value)``: daily and monthly users, revenue per group.

    The series keep one row per key, so they stay distributed however many
    countries or campaigns there are.
    """
    days = events.where(F.col("event_date").isNotNull())
    daily = days.groupBy(F.col("event_date").cast("string").alias("key")).agg(
        F.count_distinct("user_id").cast("double").alias("value")
    )
    monthly = days.groupBy(month_key(F.col("event_date")).alias("key")).agg(
        F.count_distinct("user_id").cast("double").alias("value")
    )
    names = REVENUE_SERIES
    return _series(daily, monthly, segment_totals(events, list(names)), names)


def kpi_series_of(cube: DayCube) -> DataFrame:
    """``kpi_series`` read from a day cube."""
    value = F.col("users").cast("double").alias("value")
    daily = cube.active_users(F.col("day").cast("string")).select("key", value)
    monthly = cube.active_users(month_key(F.col("day"))).select("key", value)
    return _series(daily, monthly, cube.segment_totals().where(F.col("dimension").isin(list(REVENUE_SERIES))), REVENUE_SERIES)


def _series(daily: DataFrame, monthly: DataFrame, totals: DataFrame, names: dict[str, str]) -> DataFrame:
    revenue = totals.select(
        _renamed("dimension", names).alias("metric"), F.col("segment").alias("key"), F.col("revenue").alias("value")
    )
    return (
        daily.select(F.lit("daily_active_users").alias("metric"), "key", "value")
        .unionByName(monthly.select(F.lit("monthly_active_users").alias("metric"), "key", "value"))
        .unionByName(revenue)
    )


def _renamed(column: str, names: dict[str, str]):
    result = F.lit(None).cast("string")
    for old, new in names.items():
        result = F.when(F.col(column) == old, new).otherwise(result)
    return result


def kpi_cards(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    """Eight rows ``(position, label, value)`` of display text."""
    values = [
        number_label(F.col("total_users")),
        currency_label(F.col("total_revenue")),
        currency_label(F.col("arpu")),
        currency_label(F.col("arppu")),
        percent_label(F.col("conversion_rate_pct")),
        number_label(F.col("avg_session_duration")),
        number_label(F.col("total_sessions")),
        number_label(F.col("total_events")),
    ]
    cards = F.array(
        *[F.struct(F.lit(label).alias("label"), value.alias("value")) for label, value in zip(CARD_LABELS, values)]
    )
    listed = kpi_snapshot(events, filters).select(F.posexplode(cards).alias("at", "card"))
    return listed.select((F.col("at") + 1).alias("position"), "card.label", "card.value")
