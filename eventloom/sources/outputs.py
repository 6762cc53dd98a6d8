"""Writers for results.

Tables are written by all tasks at once, as CSV or JSON lines. Only texts and
report documents, whose number of lines is fixed, are put into one row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.measures import one_row
from eventloom.operators.day_cube import DayCube
from eventloom.operators.kpis import kpi_series, kpi_series_of, metric_rows
from eventloom.operators.segments import segment_summary
from eventloom.wording import ADVICE_HEADING, BATCH_INSIGHTS_TITLE, INSIGHTS_HEADING

BATCH_RULE = 55
REPORT_RULE = 60
MICROSECONDS = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"  # the default cuts timestamps at milliseconds

# File name -> dimension.
SEGMENT_FILES = {
    "top_countries": "country",
    "campaign_performance": "campaign",
    "device_summary": "device_type",
}


def export_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").options(header=True, escape='"', timestampNTZFormat=MICROSECONDS).csv(path)


def export_json(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def export_bundle(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Each table as JSON lines in a folder of its name."""
    for name, table in tables.items():
        export_json(table, f"{folder}/{name}")


def write_summary_metrics(kpis: DataFrame, path: str) -> None:
    export_csv(metric_rows(kpis), path)


def write_segments(events: DataFrame | DayCube, folder: str) -> None:
    """One CSV folder for each dimension of SEGMENT_FILES, from events or from their day cube."""
    for name, dimension in SEGMENT_FILES.items():
        table = events.segment_summary(dimension) if isinstance(events, DayCube) else segment_summary(events, dimension)
        export_csv(table, f"{folder}/{name}")


def analytics_summary(events: DataFrame | DayCube, kpis: DataFrame) -> DataFrame:
    """Rows ``(metric, key, value)``: scalar KPIs (no key) and the KPI series, from events or from their day cube."""
    scalars = metric_rows(kpis).select("metric", F.lit(None).cast("string").alias("key"), "value")
    return scalars.unionByName(kpi_series_of(events) if isinstance(events, DayCube) else kpi_series(events))


def lines_of(texts: DataFrame) -> DataFrame:
    """One row: the texts of ``(position, text)`` as an ordered array."""
    listed = F.sort_array(F.collect_list(F.struct("position", "text")))
    return texts.agg(F.transform(listed, lambda line: line["text"]).alias("lines"))


def _joined(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(part) if isinstance(part, str) else part for part in parts])


def insights_document(insights: DataFrame) -> DataFrame:
    """The batch insights under their title, as one text."""
    body = F.concat_ws("\n", F.col("lines"))
    return lines_of(insights).select(_joined(BATCH_INSIGHTS_TITLE, "=" * BATCH_RULE, "", body).alias("text"))


def live_document(insights: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Live insights and recommendations as one text."""

    def bullets(name: str) -> Column:
        return F.concat_ws("\n", F.transform(F.col(name), lambda line: F.concat(F.lit("- "), line)))

    both = lines_of(insights).select(
        F.col("lines").alias("insights"), lines_of(recommendations).scalar().alias("recommendations")
    )
    rule = "=" * REPORT_RULE
    text = _joined(
        INSIGHTS_HEADING, rule, "", bullets("insights"), "", ADVICE_HEADING, rule, "", bullets("recommendations")
    )
    return both.select(text.alias("text"))


def json_report(
    kpis: DataFrame, advanced: DataFrame, previous: DataFrame | None, insights: DataFrame, recommendations: DataFrame
) -> DataFrame:
    """One JSON document; the previous period is null where there is none."""
    missing = F.lit(None).cast("string")
    report = F.struct(
        F.struct(*kpis.columns).alias("kpis"),
        one_row(advanced).alias("advanced_kpis"),
        (one_row(previous) if previous is not None else missing).alias("previous_period_kpis"),
        lines_of(insights).scalar().alias("business_insights"),
        lines_of(recommendations).scalar().alias("executive_recommendations"),
    )
    return kpis.select(F.to_json(report, {"ignoreNullFields": "false"}).alias("text"))


def write_document(document: DataFrame, path: str) -> None:
    document.select("text").write.mode("overwrite").text(path)
