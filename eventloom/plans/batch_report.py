"""The batch report: a CSV file of raw events to metrics, segments and insights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventloom.operators.day_cube import DayCube
from eventloom.operators.insights import batch_facts_of, batch_insights_from
from eventloom.session import durable
from eventloom.sources import outputs
from eventloom.sources.csv_events import load_batch_events
from eventloom.sources.tables import read_events, write_events


def clean_to_table(spark: SparkSession, csv_path: str, path: str) -> DataFrame:
    """Clean once and write the result, so that no later step cleans again."""
    events = load_batch_events(spark, csv_path)
    write_events(events, path)
    return read_events(spark, path, events.schema)


def run(spark: SparkSession, csv_path: str, folder: str) -> None:
    """All files of the report, read from one day cube; KPIs and leaders are computed once, as one row."""
    events = clean_to_table(spark, csv_path, f"{folder}/events")
    reports = f"{folder}/reports"
    cube = DayCube.of(events)
    facts = durable(batch_facts_of(cube))
    kpis = facts.drop("stages", "top")
    outputs.write_summary_metrics(kpis, f"{reports}/summary_metrics")
    outputs.write_segments(cube, reports)
    outputs.export_json(outputs.analytics_summary(cube, kpis), f"{reports}/analytics_summary")
    outputs.write_document(outputs.insights_document(batch_insights_from(facts)), f"{reports}/business_insights")
