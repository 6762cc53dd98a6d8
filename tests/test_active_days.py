"""Active days as bits, against sets of dates; and detectors from one pass."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from conftest import rows

from eventloom.filters import EventFilters
from eventloom.operators import anomaly, retention
from eventloom.schema import COHORT_DAYS

MOBILE = EventFilters(devices=("Mobile",))


@pytest.fixture(scope="module")
def odd_events(make_events):
    """Leap days, year ends, days and users and devices that are null, repeated rows."""
    rng = random.Random(5)
    made = []
    for i in range(600):
        day = date(2023, 12, 20) + timedelta(days=rng.randrange(100))
        made.append({
            "user_id": rng.choice([None, *[f"u{k}" for k in range(40)]]), "event_date": rng.choice([day] * 20 + [None]),
            "device_type": rng.choice(["Mobile", "Tablet", None]), "campaign": rng.choice(["a", "b", None]), "paid": str(rng.randrange(90)),
        })
    made += [{"user_id": "end", "event_date": d} for d in ("2024-01-31", "2024-02-01", "2024-03-01", "2024-02-29")]
    made += [{"user_id": "undated", "event_date": None}]
    return make_events(*made, *made[:50])


def calendars(events, filters):
    """By user: the first chosen day and all days, of users with a chosen row."""
    out = {}
    for row in events.select("user_id", "event_date", "device_type").collect():
        if row.user_id is not None:
            user = out.setdefault(row.user_id, ([], set()))
            user[1].add(row.event_date)
            if filters is None or row.device_type == "Mobile":
                user[0].append(row.event_date)
    first = {u: min((d for d in chosen if d), default=None) for u, (chosen, _) in out.items() if chosen}
    return {u: (first[u], out[u][1]) for u in first}


@pytest.mark.parametrize("filters", [None, MOBILE])
def test_days_and_cohorts_match_sets(odd_events, filters):
    known = calendars(odd_events, filters)
    found = retention.user_first_and_activity_dates(odd_events, filters).collect()
    assert len(found) == len(set(found))
    assert set(found) == {(u, first, d) for u, (first, days) in known.items() for d in days}
    expected = {}
    for first, days in known.values():
        if first:
            hits = expected.setdefault(f"{first:%Y-%m}", [])
            hits.append([first + timedelta(days=n) in days for n in COHORT_DAYS])
    for row in retention.cohort_table(odd_events, filters).collect():
        hits = expected.pop(row.cohort_month)
        assert row.cohort_size == len(hits)
        for n, column in zip(COHORT_DAYS, zip(*hits, strict=True), strict=True):
            assert row[f"Day {n}"] == pytest.approx(100 * sum(column) / len(hits), abs=0.0051)
    assert not expected


def test_month_cohorts_match_sets(odd_events):
    expected = {}
    for first, days in calendars(odd_events, None).values():
        for month in {d and f"{d:%Y-%m}" for d in days}:
            cell = (first and f"{first:%Y-%m}", month)
            expected[cell] = expected.get(cell, 0) + 1
    found = retention.cohort_activity_by_month(odd_events).collect()
    assert {(r.cohort_month, r.activity_month): r.active_users for r in found} == expected and len(found) == len(expected)


@pytest.mark.parametrize("make", [retention.cohort_table, retention.user_first_and_activity_dates, retention.cohort_activity_by_month])
def test_no_window_over_users(odd_events, make):
    plan = make(odd_events)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "event_date#" in plan


@pytest.mark.parametrize("filters", [None, MOBILE])
def test_detectors_of_one_pass_equal_those_alone(odd_events, filters):
    found = anomaly.Detectors(odd_events, filters, users=True)
    assert rows(found.cohorts()) == rows(retention.cohort_table(odd_events, filters))
    assert rows(found.revenue()) == rows(anomaly.revenue_anomalies(odd_events, filters)) != []
    assert rows(found.campaigns()) == rows(anomaly.campaign_anomalies(odd_events, filters))
    traffic = [{k: r[k] for k in ("date", "event_count", "z_score", "direction")} for r in rows(anomaly.traffic_anomalies(odd_events, filters))]
    assert rows(found.traffic()) == traffic != []
    cards = anomaly.warning_cards(odd_events, filters, retention.cohort_table(odd_events, filters))
    assert rows(anomaly.warning_report(odd_events, filters)) == rows(cards)
    nothing = rows(anomaly.warning_report(odd_events.limit(0), filters))
    assert [r["severity"] for r in nothing] == ["info"]
