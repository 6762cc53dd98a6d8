"""Tables, outputs and the end-to-end jobs."""

from __future__ import annotations

import json
from datetime import date

import pytest
from conftest import rows

from eventloom.operators.kpis import batch_kpis
from eventloom.plans import batch_report, dashboard
from eventloom.schema import EVENT_COLUMNS
from eventloom.session import fresh_path, shared_folder
from eventloom.sources import outputs, tables
from eventloom.sources.csv_events import load_report


@pytest.fixture
def events(make_events):
    return make_events(
        *[
            {
                "user_id": f"u{i % 7}", "session_id": f"s{i}", "event_date": date(2025, 1 + i % 2, 1 + i % 20),
                "campaign": ["X", "Y", "None"][i % 3], "country": "AB"[i % 2], "paid": str(i % 5),
            }
            for i in range(60)
        ]
    )


def test_table_round_trip_and_pruning(spark, events, tmp_path):
    path = str(tmp_path / "events")
    tables.write_events(events, path)
    table = tables.read_events(spark, path)
    assert table.columns == EVENT_COLUMNS
    assert sorted(table.collect()) == sorted(events.collect())
    plan = table.where("event_date = date'2025-01-03'").select("user_id")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert rows(tables.row_count(table)) == [{"n": 60}]


def test_ensure_builds_only_when_needed(spark, events, tmp_path):
    path, built = str(tmp_path / "events"), []

    def build():
        built.append(1)
        return events

    assert not tables.is_filled(spark, path)
    for force in (False, False, True):
        assert tables.ensure_events(spark, path, build, force).count() == 60
    assert len(built) == 2
    tables.write_events(events.limit(0), path)
    assert not tables.is_filled(spark, path)


def test_create_table(spark, events):
    tables.create_events_table(spark, "product", "user_events")
    events.write.insertInto("product.user_events") if spark.table("product.user_events").columns == EVENT_COLUMNS else (
        events.select(*spark.table("product.user_events").columns).write.insertInto("product.user_events")
    )
    assert spark.table("product.user_events").count() == 60
    tables.create_events_table(spark, "product", "user_events")
    assert spark.table("product.user_events").count() == 0
    types = dict(spark.table("product.user_events").dtypes)
    assert (types["revenue"], types["event_timestamp"], types["retention_day"]) == ("decimal(18,2)", "timestamp_ntz", "int")


def test_batch_report(spark, events, tmp_path):
    csv, out = str(tmp_path / "csv"), str(tmp_path / "out")
    outputs.export_csv(events, csv)
    batch_report.run(spark, csv, out)
    metrics = {r["metric"]: r["value"] for r in rows(load_report(spark, f"{out}/reports/summary_metrics"))}
    assert metrics["total_events"] == 60 and metrics["total_users"] == 7
    countries = rows(load_report(spark, f"{out}/reports/top_countries"))
    assert [c["country"] for c in countries] == ["A", "B"]
    text = [r.value for r in spark.read.text(f"{out}/reports/business_insights").collect()]
    assert text[0].startswith("PRODUCT ANALYTICS") and text[1] == "=" * 55 and len(text) == 27
    summary = rows(spark.read.json(f"{out}/reports/analytics_summary"))
    assert {r["metric"] for r in summary} >= {"daily_active_users", "revenue_per_campaign", "arpu"}


def test_dashboard_tables_all_run(events):
    selection = {"date_range": (date(2025, 2, 1), date(2025, 2, 28)), "campaigns": ["X", "Y"]}
    for part in (dashboard.overview, dashboard.analytics_center):
        for name, table in part(events, selection).items():
            assert table.columns, name
            table.collect()


def test_building_the_dashboard_runs_no_job(spark, events):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "no job expected")
    for part in (dashboard.overview, dashboard.analytics_center):
        assert len(part(events, {})) > 20
    assert list(tracker.getJobIdsForGroup("building")) == []
    spark.sparkContext.setJobGroup("other", "")


def test_json_report(events):
    selection = {"date_range": (date(2025, 2, 1), date(2025, 2, 28))}
    report = json.loads(dashboard.live_report(events, selection)["json"].first().text)
    assert set(report) == {
        "kpis", "advanced_kpis", "previous_period_kpis", "business_insights", "executive_recommendations",
    }
    assert report["kpis"]["total_users"] == 7 and report["previous_period_kpis"]["total_users"] == 7
    assert 8 <= len(report["business_insights"]) <= 12
    alone = json.loads(dashboard.live_report(events, {})["json"].first().text)
    assert alone["previous_period_kpis"] is None


def test_bundle(spark, events, tmp_path):
    outputs.export_bundle({"kpis": batch_kpis(events)}, str(tmp_path))
    assert rows(spark.read.json(str(tmp_path / "kpis")))[0]["total_events"] == 60


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert fresh_path(spark, "x") != fresh_path(spark, "x")
