"""Every registered query: ``(spark, folder of the driver's tables) -> DataFrame``.

``clicks`` and ``orders`` are the two event views over those tables. Queries on
``orders`` carry that suffix where both views are used.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.filters import EventFilters, date_bounds, filter_options
from eventloom.functions import keys, numbers
from eventloom.functions.measures import money
from eventloom.operators import (
    anomaly,
    chart_data,
    cleaning,
    distribution,
    growth,
    insights,
    kpis,
    retention,
    rfm,
    segments,
    warehouse,
)
from eventloom.operators.catalog import NAMED_QUERIES
from eventloom.operators.funnel import stage_users
from eventloom.plans import batch_report, dashboard
from eventloom.schema import EVENT_COLUMNS, FUNNEL_STAGES, SEGMENT_DIMENSIONS
from eventloom.session import fresh_path
from eventloom.sources import outputs, tables
from eventloom.sources.csv_events import load_batch_events, load_dashboard_events, load_report, read_raw_events
from eventloom.sources.star_views import click_events, click_events_raw, order_events

QUERIES = {}

# Selections used by queries that have a filter as their subject.
CLICK_FILTER = EventFilters(
    start_date=date(2024, 1, 11),
    end_date=date(2024, 1, 20),
    devices=("Mobile", "Desktop"),
    subscriptions=("Free", "Monthly"),
)
CLICK_RANGE = EventFilters(start_date=date(2024, 1, 11), end_date=date(2024, 1, 20))
ORDER_FILTER = EventFilters(start_date=date(1996, 1, 1), end_date=date(1999, 12, 31), user_types=("Returning",))


def query(name: str):
    def add(function):
        QUERIES[name] = function
        return function

    return add


def _on(name: str, view, operator, *args, **options) -> None:
    QUERIES[name] = lambda spark, folder: operator(view(spark, folder), *args, **options)


def _steady(table: DataFrame, digits: int = 6) -> DataFrame:
    """Unrounded doubles, rounded for comparison."""
    rounded = {f.name: F.round(f.name, digits) for f in table.schema if f.dataType.typeName() == "double"}
    return table.withColumns(rounded)


# Named queries on clicks, the calendar ones on orders too, and under filters.
ON_ORDERS = (
    "dau", "wau", "mau", "stickiness_dau_mau", "revenue_trend", "monthly_revenue", "purchase_frequency",
    "retention_overall_rate", "monthly_growth", "weekly_growth", "campaign_growth", "country_device_matrix",
    "new_user_acquisition_trend", "user_level_aggregate", "user_first_and_activity_dates", "kpi_snapshot",
)
FILTERED = (
    "stickiness_dau_mau", "purchase_frequency", "funnel", "retention_overall_rate", "country_device_matrix",
    "user_first_and_activity_dates", "kpi_snapshot", "traffic_source_analysis",
)
for _name, _operator in NAMED_QUERIES.items():
    _on(_name, click_events, _operator)
    if _name in ON_ORDERS:
        _on(f"{_name}_orders", order_events, _operator)
    if _name in FILTERED:
        _on(f"{_name}_filtered", click_events, _operator, CLICK_FILTER)
_on("user_first_and_activity_dates_orders_filtered", order_events, retention.user_first_and_activity_dates, ORDER_FILTER)
_on("top_cities_orders", order_events, NAMED_QUERIES["top_cities"])

# Warehouse report queries.
_on("warehouse_dau", click_events, warehouse.dau_latest_first)
_on("warehouse_wau", order_events, warehouse.wau_latest_first)
_on("warehouse_mau", order_events, warehouse.mau_latest_first)
_on("warehouse_monthly_revenue", order_events, warehouse.monthly_revenue_latest_first)
_on("warehouse_event_funnel", click_events, warehouse.event_funnel)
_on("warehouse_cohort_months", order_events, retention.cohort_activity_by_month)
_on("warehouse_top_channels", click_events, warehouse.top_channels)


# Cleaning and load profiles.
@query("clean_for_batch")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.clean_for_batch(click_events_raw(spark, folder))


@query("clean_for_dashboard")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.clean_for_dashboard(click_events_raw(spark, folder))


@query("clean_for_import")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.clean_for_import(click_events_raw(spark, folder))


@query("duration_cap")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.duration_cap(click_events_raw(spark, folder).dropDuplicates())


_on("cleaning_report", click_events_raw, cleaning.cleaning_report)


# Sources. Each query writes the whole view to a new folder and loads it again.
def _as_csv(spark: SparkSession, folder: str, name: str, sep: str = ",") -> str:
    path = fresh_path(spark, name)
    events = click_events_raw(spark, folder).select(*EVENT_COLUMNS)
    events.write.options(header=True, sep=sep, escape='"', timestampNTZFormat=outputs.MICROSECONDS).csv(path)
    return path


@query("csv_batch_load")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return load_batch_events(spark, _as_csv(spark, folder, "csv-batch"))


@query("csv_dashboard_load")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return load_dashboard_events(spark, _as_csv(spark, folder, "csv-dashboard"))


@query("csv_bulk_load")
def _(spark: SparkSession, folder: str) -> DataFrame:
    path = _as_csv(spark, folder, "csv-bulk", sep="|")
    return cleaning.cast_columns(read_raw_events(spark, path, sep="|"))


@query("import_events")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return tables.import_events(spark, _as_csv(spark, folder, "csv-import"), fresh_path(spark, "events"))


@query("import_events_line_breaks")
def _(spark: SparkSession, folder: str) -> DataFrame:
    """Cities with line breaks and quotes, written as CSV and imported."""
    path = fresh_path(spark, "csv-breaks")
    events = _broken_cities(click_events_raw(spark, folder)).select(*EVENT_COLUMNS)
    events.write.options(header=True, escape='"', quoteAll=True, timestampNTZFormat=outputs.MICROSECONDS).csv(path)
    return tables.import_events(spark, path, fresh_path(spark, "events"), line_breaks=True)


@query("import_new_events")
def _(spark: SparkSession, folder: str) -> DataFrame:
    """Two halves of the view as files of one folder, imported as they come; then one half again, changed."""
    source, path = fresh_path(spark, "csv-parts"), fresh_path(spark, "events")
    events = click_events_raw(spark, folder).select(*EVENT_COLUMNS)
    first = F.pmod(F.dayofmonth("event_date"), F.lit(2)) == 0

    def put(rows: DataFrame, mode: str = "append") -> None:
        rows.write.options(header=True, escape='"', timestampNTZFormat=outputs.MICROSECONDS).mode(mode).csv(source)
        tables.import_new_events(spark, source, path)

    put(events.where(first))
    put(events.where(~first))
    put(events.where(~first), "overwrite")
    return tables.read_events(spark, path)


def _odd_numbers(events: DataFrame) -> DataFrame:
    """The view as text, with counts and amounts that do not fit."""
    seconds, amount = F.col("session_duration").cast("string"), F.col("revenue").cast("string")
    case = F.pmod("session_duration", F.lit(10))
    texts = events.select(*[F.col(c).cast("string").alias(c) for c in EVENT_COLUMNS])
    seconds = F.when(case == 1, "3000000000").when(case == 2, F.concat(seconds, F.lit(".7"))).when(case == 3, "x").when(case == 4, F.concat(seconds, F.lit(".0"))).otherwise(seconds)
    amount = F.when(case == 5, F.concat(amount, F.lit("4"))).when(case == 6, "1e30").when(case == 7, "-").otherwise(amount)
    return texts.withColumns({"session_duration": seconds, "revenue": amount})


@query("rejected_values")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.rejected_values(_odd_numbers(click_events_raw(spark, folder))).select("user_id", "event_timestamp", "column", "reason", "value")


@query("rejected_counts")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.rejected_counts(_odd_numbers(click_events_raw(spark, folder)))


def _broken_cities(events: DataFrame) -> DataFrame:
    return events.withColumn("city", F.concat(F.lit('a "b"\n'), "city", F.lit(",\nc")))


@query("events_table")
def _(spark: SparkSession, folder: str) -> DataFrame:
    """The view inserted into a table made by its DDL."""
    name = f"eventloom_{uuid.uuid4().hex}"
    tables.create_events_table(spark, name)
    events = click_events(spark, folder)
    columns = spark.table(f"{name}.user_events").columns
    events.select(*columns).write.insertInto(f"{name}.user_events")
    return spark.table(f"{name}.user_events").select(*EVENT_COLUMNS)


@query("ensure_events")
def _(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "events")
    tables.ensure_events(spark, path, lambda: click_events(spark, folder))
    return tables.row_count(tables.ensure_events(spark, path, lambda: click_events(spark, folder)))


_on("row_count", click_events, tables.row_count)
_on("filter_options", click_events, filter_options)
_on("date_bounds", order_events, date_bounds)


# Scalar functions, one row per event date or user.
@query("calendar_keys")
def _(spark: SparkSession, folder: str) -> DataFrame:
    day = F.col("event_date")
    return (
        order_events(spark, folder)
        .select("event_date")
        .distinct()
        .select(
            "event_date",
            keys.month_key(day).alias("year_month"),
            keys.monday_week_key(day).alias("year_week"),
            keys.iso_week_number(day).alias("iso_week"),
            keys.week_span(day).alias("week_span"),
            keys.weekday_name(day).alias("weekday"),
        )
    )


@query("number_labels")
def _(spark: SparkSession, folder: str) -> DataFrame:
    per_user = order_events(spark, folder).groupBy("user_id").agg(F.sum(money()).cast("double").alias("spent"))
    spent = F.col("spent")
    return per_user.select(
        "user_id",
        numbers.currency_label(spent).alias("currency"),
        numbers.number_label(spent).alias("number"),
        numbers.percent_label(spent / 1000, 2).alias("percent"),
        numbers.compact_label(spent * 100, "$").alias("compact"),
        numbers.compact_label(spent / 1000, suffix="K").alias("small"),
        numbers.ratio_or(spent, spent - spent).alias("safe"),
    )


@query("first_present")
def _(spark: SparkSession, folder: str) -> DataFrame:
    """The first category of each event that is there, on the view with gaps."""
    first = numbers.first_present(F.col("campaign"), F.col("city"), default=F.lit("none"))
    return click_events_raw(spark, folder).groupBy(first.alias("first")).agg(F.count(F.lit(1)).alias("events"))


# KPIs.
@query("batch_kpis")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _steady(kpis.batch_kpis(cleaning.clean_for_batch(click_events_raw(spark, folder))))


@query("batch_kpis_orders")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _steady(kpis.batch_kpis(order_events(spark, folder)))


@query("kpi_series")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.kpi_series(order_events(spark, folder))


@query("dashboard_kpis")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _steady(kpis.dashboard_kpis(click_events(spark, folder)))


@query("dashboard_kpis_filtered")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _steady(kpis.dashboard_kpis(click_events(spark, folder), CLICK_FILTER))


@query("dashboard_kpis_orders")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _steady(kpis.dashboard_kpis(order_events(spark, folder)))


@query("advanced_kpis")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _steady(kpis.advanced_kpis(click_events(spark, folder)))


@query("advanced_kpis_orders")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _steady(kpis.advanced_kpis(order_events(spark, folder)))


@query("period_comparison")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _steady(kpis.period_comparison(click_events(spark, folder), CLICK_RANGE))


@query("filtered_summary_metrics")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _steady(kpis.filtered_summary_metrics(click_events(spark, folder), CLICK_RANGE))


_on("kpi_cards", order_events, kpis.kpi_cards)


# Segments.
@query("segmentation")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _steady(segments.segmentation(click_events(spark, folder)))


for _dimension in SEGMENT_DIMENSIONS[:1] + ("campaign", "device_type"):
    QUERIES[f"segment_summary_{_dimension}"] = lambda spark, folder, d=_dimension: _steady(
        segments.segment_summary(click_events(spark, folder), d)
    )
for _dimension in dashboard.SUMMARY_DIMENSIONS:
    QUERIES[f"summary_table_{_dimension}"] = lambda spark, folder, d=_dimension: _steady(
        segments.summary_table(click_events(spark, folder), d)
    )


@query("monthly_growth_table")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _steady(growth.monthly_growth_table(order_events(spark, folder)))


_on("top_campaign_growth", order_events, growth.top_campaign_growth)


# Cohorts, segments of users, anomalies, distributions.
_on("cohort_table", click_events, retention.cohort_table)
_on("cohort_table_orders", order_events, retention.cohort_table)
_on("cohort_table_filtered", order_events, retention.cohort_table, ORDER_FILTER)


@query("cohort_cells")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return retention.cohort_cells(retention.cohort_table(order_events(spark, folder)))


@query("cohort_insights")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return retention.cohort_insights(retention.cohort_table(order_events(spark, folder)))


_on("rfm_table", order_events, rfm.rfm_table)
_on("rfm_table_clicks", click_events, rfm.rfm_table)
_on("rfm_table_snapshot", order_events, rfm.rfm_table, None, date(2000, 6, 30))
_on("rfm_table_filtered", order_events, rfm.rfm_table, ORDER_FILTER)


@query("rfm_segment_summary")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return rfm.rfm_segment_summary(rfm.rfm_table(order_events(spark, folder)))


_on("revenue_anomalies", order_events, anomaly.revenue_anomalies)
_on("revenue_anomalies_clicks", click_events, anomaly.revenue_anomalies)
_on("traffic_anomalies", order_events, anomaly.traffic_anomalies)
_on("traffic_anomalies_clicks", click_events, anomaly.traffic_anomalies)
_on("campaign_anomalies", order_events, anomaly.campaign_anomalies)


@query("retention_anomalies")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return anomaly.retention_anomalies(retention.cohort_table(order_events(spark, folder)))


@query("warning_cards")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return anomaly.warning_report(order_events(spark, folder))


@query("warning_cards_shown")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return anomaly.shown_cards(anomaly.warning_report(order_events(spark, folder)))


_on("warning_cards_clicks", click_events, anomaly.warning_cards)
_on("retention_heatmap", click_events, retention.retention_heatmap)


@query("retention_heatmap_day_zero")
def _(spark: SparkSession, folder: str) -> DataFrame:
    """With a day 0, and rows without a day."""
    day = F.col("retention_day")
    events = click_events(spark, folder).withColumn("retention_day", F.when(day == 1, 0).when(day != 90, day))
    return retention.retention_heatmap(events)




@query("duration_histogram")
def _(spark: SparkSession, folder: str) -> DataFrame:
    clean = cleaning.cap_durations(click_events(spark, folder))
    return _steady(distribution.duration_histogram(clean), 9)


@query("duration_density")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _steady(distribution.duration_density(click_events(spark, folder)), 9)


# Chart data.
QUERIES["chart_dau_trend"] = lambda spark, folder: _steady(chart_data.dau_smoothed(click_events(spark, folder)))
_on("chart_revenue_by_country", click_events, chart_data.revenue_by, "country")
_on("chart_revenue_by_device", click_events, chart_data.revenue_by, "device_type", earning_only=True)
_on("chart_revenue_by_campaign", click_events, chart_data.revenue_by, "campaign", ascending=True)
_on("chart_events_by_device", click_events, chart_data.events_by, "device_type")
_on("chart_events_by_traffic_source", click_events, chart_data.events_by, "traffic_source")
_on("chart_funnel", click_events, stage_users, FUNNEL_STAGES)
_on("chart_subscription_users", click_events, chart_data.subscription_users)
_on("chart_user_type_users", click_events, chart_data.user_type_users)
_on("chart_retention_day_users", click_events, chart_data.retention_day_users)


# Texts.
@query("batch_insights")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return insights.batch_insights(cleaning.clean_for_batch(click_events_raw(spark, folder)))


_on("live_insights", click_events, insights.live_insights)
_on("live_insights_filtered", click_events, insights.live_insights, CLICK_FILTER)
_on("live_insights_orders", order_events, insights.live_insights)
_on("recommendations", click_events, insights.recommendations, CLICK_RANGE)
_on("recommendations_orders", order_events, insights.recommendations)
_on("executive_summary", click_events, insights.executive_summary, CLICK_RANGE)


@query("report_insights")
def _(spark: SparkSession, folder: str) -> DataFrame:
    events = order_events(spark, folder)
    return insights.report_insights(events, rfm.rfm_segment_summary(rfm.rfm_table(events)))


# Outputs: written in full, then read back.
@query("summary_metrics_file")
def _(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "summary-metrics")
    outputs.write_summary_metrics(kpis.batch_kpis(order_events(spark, folder)), path)
    return _steady(load_report(spark, path))


@query("segment_files")
def _(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "segments")
    outputs.write_segments(click_events(spark, folder), path)
    saved = None
    for name, dimension in outputs.SEGMENT_FILES.items():
        rows = load_report(spark, f"{path}/{name}").select(
            F.lit(name).alias("file"), F.col(dimension).alias("segment"),
            *[F.col(c).cast(t) for c, t in (("users", "long"), ("events", "long"), ("revenue", "double"))],
        )
        saved = rows if saved is None else saved.unionByName(rows)
    return saved


@query("insights_file")
def _(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "insights")
    outputs.write_document(outputs.insights_document(insights.batch_insights(click_events(spark, folder))), path)
    return spark.read.text(path).select(F.col("value").alias("text"))


@query("analytics_summary_file")
def _(spark: SparkSession, folder: str) -> DataFrame:
    events = order_events(spark, folder)
    path = fresh_path(spark, "analytics-summary")
    outputs.export_json(outputs.analytics_summary(events, kpis.batch_kpis(events)), path)
    return _steady(spark.read.schema("metric string, key string, value double").json(path))


@query("json_report_file")
def _(spark: SparkSession, folder: str) -> DataFrame:
    """All five sections of the report document: numbers, names and lines."""
    path = fresh_path(spark, "json-report")
    report = dashboard.live_report(click_events(spark, folder), {"date_range": (date(2024, 1, 11), date(2024, 1, 20))})
    outputs.write_document(report["json"], path)
    numbered, listed = ("kpis", "previous_period_kpis", "advanced_kpis"), ("business_insights", "executive_recommendations")
    schema = ", ".join([f"{s} map<string,string>" for s in numbered] + [f"{s} array<string>" for s in listed])
    parsed = spark.read.text(path).select(F.from_json("value", schema).alias("report"))
    lines = [F.map_from_entries(F.transform(f"report.{s}", lambda x, i: F.struct((i + 1).cast("string"), x))) for s in listed]
    parts = [F.struct(F.lit(s).alias("section"), F.col(f"report.{s}").alias("values")) for s in numbered]
    parts += [F.struct(F.lit(s).alias("section"), line.alias("values")) for s, line in zip(listed, lines)]
    sections = parsed.select(F.explode(F.array(*parts)).alias("part"))
    number = F.col("text").try_cast("double")
    return sections.select("part.section", F.explode("part.values").alias("metric", "text")).select(
        "section", "metric", F.round(number, 6).alias("value"), F.when(number.isNull(), F.col("text")).alias("text")
    )


@query("live_report_text")
def _(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "live-report")
    report = dashboard.live_report(click_events(spark, folder), {"date_range": (date(2024, 1, 11), date(2024, 1, 20))})
    outputs.write_document(report["text"], path)
    return spark.read.text(path).select(F.col("value").alias("text"))


@query("export_bundle")
def _(spark: SparkSession, folder: str) -> DataFrame:
    events = click_events(spark, folder)
    path = fresh_path(spark, "bundle")
    chosen = {name: NAMED_QUERIES[name](events) for name in ("revenue_by_country", "revenue_by_device", "top_campaigns")}
    outputs.export_bundle(chosen, path)
    saved = None
    for name, dimension in (("revenue_by_country", "country"), ("revenue_by_device", "device_type"), ("top_campaigns", "campaign")):
        rows = spark.read.schema(f"{dimension} string, revenue double, users long, arpu double").json(f"{path}/{name}")
        rows = rows.withColumnRenamed(dimension, "segment").withColumn("file", F.lit(name))
        saved = rows if saved is None else saved.unionByName(rows)
    return saved


@query("batch_report_job")
def _(spark: SparkSession, folder: str) -> DataFrame:
    """The whole batch job from CSV; the saved metrics are read back."""
    out = fresh_path(spark, "batch-report")
    batch_report.run(spark, _as_csv(spark, folder, "csv-report"), out)
    return _steady(load_report(spark, f"{out}/reports/summary_metrics"))
