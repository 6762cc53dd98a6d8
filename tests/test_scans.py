"""How often plans read all events, by the input records of stages that ran."""

from __future__ import annotations

import uuid
from datetime import date

import pytest

from checks.spark_queries import CLICK_RANGE
from eventloom.operators import anomaly, insights, kpis, retention, rfm
from eventloom.plans import batch_report, dashboard
from eventloom.schema import EVENT_COLUMNS
from eventloom.sources import outputs, tables
from eventloom.sources.star_views import click_events

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("scans") / "events")
    tables.write_events(click_events(spark, FOLDER), path)
    return tables.read_events(spark, path)


def full_scans(spark, run, least: int) -> int:
    """Stages that read at least so many records from files."""
    context = spark.sparkContext
    group = uuid.uuid4().hex
    context.setJobGroup(group, "scans")
    run()
    context.setJobGroup("none", "")
    store, tracker = context._jsc.sc().statusStore(), context.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    return sum(store.lastStageAttempt(s).inputRecords() >= least for s in stages if store.lastStageAttempt(s).status().toString() != "SKIPPED")


CASES = {
    "advanced_kpis": (lambda e: kpis.advanced_kpis(e), 3),
    "live_insights": (lambda e: insights.live_insights(e), 3),
    "period_comparison": (lambda e: kpis.period_comparison(e, CLICK_RANGE), 2),
    "executive_summary": (lambda e: insights.executive_summary(e, CLICK_RANGE), 2),
    "recommendations": (lambda e: insights.recommendations(e, CLICK_RANGE), 3),
    "warning_report": (lambda e: anomaly.warning_report(e, CLICK_RANGE), 1),
    "warning_cards": (lambda e: anomaly.warning_cards(e, CLICK_RANGE), 1),
    "cohort_table": (lambda e: retention.cohort_table(e, CLICK_RANGE), 1),
    "rfm_table": (lambda e: rfm.rfm_table(e), 1),
    "json_report": (lambda e: dashboard.live_report(e, {"date_range": (date(2024, 1, 11), date(2024, 1, 20))})["json"], 4),
}


@pytest.mark.parametrize("name", CASES)
def test_full_scans(spark, stored, name):
    make, most = CASES[name]
    least = stored.where(CLICK_RANGE.predicate()).count()  # what the selection alone holds
    assert 1 <= full_scans(spark, lambda: make(stored).collect(), least) <= most


def test_full_scans_of_the_batch_report(spark, stored, tmp_path):
    stored.select(*EVENT_COLUMNS).write.options(header=True, escape='"', timestampNTZFormat=outputs.MICROSECONDS).csv(str(tmp_path / "csv"))
    rows = stored.dropDuplicates().count()
    scans = full_scans(spark, lambda: batch_report.run(spark, str(tmp_path / "csv"), str(tmp_path / "out")), rows)
    assert scans <= 8
