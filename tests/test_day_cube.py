"""Reports read from a day cube equal those taken from the events."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from eventloom.filters import EventFilters
from eventloom.operators import insights, kpis, segments
from eventloom.operators.day_cube import DayCube, _numbered
from eventloom.schema import FUNNEL_STAGES

SPAN = EventFilters(start_date=date(2025, 1, 11), end_date=date(2025, 2, 9), countries=("A", "B"))


@pytest.fixture(scope="module")
def events(make_events):
    random.seed(4)
    made = []
    for i in range(400):
        day = random.choice([None] + [date(2025, 1, 1) + timedelta(days=d) for d in (0, 1, 9, 10, 15, 31, 33, 39, 45)] * 3)
        row = {
            "user_id": random.choice([None] + [f"u{n}" for n in range(25)]), "session_id": random.choice([None, "s1", "s2", f"s{i}"]),
            "event_date": day, "event_timestamp": None if day is None or i % 17 == 0 else datetime(day.year, day.month, day.day, i % 24, i % 60),
            "country": random.choice(["A", "B", "C", None]), "device_type": random.choice(["Mobile", "Tablet", None]),
            "campaign": random.choice(["X", "Y", "None"]), "user_type": random.choice(["New", "Returning", "Zombie", None]),
            "event_name": random.choice([*FUNNEL_STAGES, "Logout", None]), "session_duration": random.choice([None, 0, 60, 61, 100_000, 3600]),
        }
        if i % 5 == 0:
            row["paid"] = f"{random.choice(['-1.50', '0', '12.34', '99.99'])}"
        made.append(row)
    # One user and one country hold a third of all rows.
    made += [{"user_id": "hot", "country": "A", "event_date": date(2025, 1, 12), "paid": "1.00"}] * 200
    return make_events(*made)


def same(a, b):
    a, b = (sorted(map(str, t.collect())) for t in (_rounded(a), _rounded(b)))
    assert a == b


def _rounded(table):
    return table.withColumns({f.name: F.round(f.name, 6) for f in table.schema if f.dataType.typeName() == "double"})


def test_batch_facts(events):
    cube = DayCube.of(events)
    same(insights.batch_facts_of(cube), insights.batch_facts(events))
    same(kpis.kpi_series_of(cube), kpis.kpi_series(events))
    for dimension in ("country", "campaign", "device_type"):
        assert rows(_rounded(cube.segment_summary(dimension))) == rows(_rounded(segments.segment_summary(events, dimension)))


@pytest.mark.parametrize("filters", [None, SPAN, EventFilters(countries=("B",)), EventFilters(start_date=date(2030, 1, 1), end_date=date(2030, 1, 2))])
def test_live_facts_of_both_periods(events, filters):
    same(insights.live_facts_of(kpis.cube_of(events, filters), kpis.COMPARED), insights.live_facts(events, filters, kpis.COMPARED))


def test_no_events(events):
    none = events.where("false")
    same(insights.batch_facts_of(DayCube.of(none)), insights.batch_facts(none))
    same(insights.live_facts_of(kpis.cube_of(none, SPAN)), insights.live_facts(none, SPAN))
    assert DayCube.of(none).segment_summary("country").count() == 0


def test_users_over_days_and_months_need_no_users(spark, events):
    cube = DayCube.of(events)
    expected = events.where("event_date is not null").groupBy(F.month("event_date").alias("key")).agg(F.count_distinct("user_id").alias("users"))
    found = cube.active_users(F.month("day"))
    same(found, expected)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "user_id" not in plan and "bitmap_or_agg" in plan


def test_numbers_have_no_gaps(spark):
    users = spark.range(100_000, numPartitions=13).where("id % 3 > 0").select(F.col("id").cast("string").alias("user_id"))
    numbers = [r.number for r in _numbered(users).collect()]
    assert sorted(numbers) == list(range(1, len(numbers) + 1)) and len(numbers) == users.count()


def test_more_users_than_a_bucket_holds(spark, make_events):
    one = make_events({"event_name": "Search"})
    many = one.drop("user_id").crossJoin(spark.range(70_000).select(F.col("id").cast("string").alias("user_id"))).select(*one.columns)
    cube = DayCube.of(many.unionByName(many))
    assert cube.counted("period").first().users == 70_000
    assert cube.people.select("bucket").distinct().count() == 3
