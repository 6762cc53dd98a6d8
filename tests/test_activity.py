"""Funnels, growth, retention and revenue on small frames."""

from __future__ import annotations

from datetime import date

import pytest
from conftest import rows

from eventloom.filters import EventFilters
from eventloom.operators import activity, breakdowns, growth, retention, revenue
from eventloom.operators.catalog import NAMED_QUERIES
from eventloom.operators.funnel import funnel


def test_funnel_with_a_missing_stage(make_events):
    events = make_events(
        {"user_id": "a"}, {"user_id": "b"}, {"user_id": "c"}, {"user_id": "a", "event_name": "Search"},
        {"user_id": "z", "paid": "5"},
    )
    result = rows(funnel(events))
    assert [r["stage"] for r in result] == ["App Open", "Search", "Add to Cart", "Purchase"]
    assert [r["users"] for r in result] == [3, 1, 0, 1]
    assert [r["conversion_from_first_pct"] for r in result] == [100.0, 33.33, 0.0, 33.33]
    assert [r["conversion_from_prev_pct"] for r in result] == [100.0, 33.33, 0.0, None]


def test_funnel_without_first_stage_divides_by_one(make_events):
    result = rows(funnel(make_events({"event_name": "Search"}), stages=["App Open", "Search", "Watch Video"]))
    assert [r["conversion_from_first_pct"] for r in result] == [0.0, 100.0, 0.0]
    assert result[0]["conversion_from_prev_pct"] == 100.0


def test_growth_from_zero_is_null(make_events):
    events = make_events(
        {"event_date": "2025-01-05", "paid": "10"}, {"event_date": "2025-02-05"}, {"event_date": "2025-04-05", "paid": "20"}
    )
    result = rows(growth.monthly_growth(events))
    assert [r["year_month"] for r in result] == ["2025-01", "2025-02", "2025-04"]
    assert [r["revenue_growth_pct"] for r in result] == [None, -100.0, None]
    assert [r["user_growth_pct"] for r in result] == [None, 0.0, 0.0]


def test_week_keys_in_results(make_events):
    events = make_events({"event_date": "2025-01-01"}, {"event_date": "2025-01-06"}, {"event_date": "2024-12-31"})
    assert [r["year_week"] for r in rows(activity.wau(events))] == ["2024-W53", "2025-W00", "2025-W01"]


def test_active_days_survive_day_31(make_events):
    events = make_events(
        {"user_id": "a", "event_date": "2025-01-31"}, {"user_id": "a", "event_date": "2025-01-30"},
        {"user_id": "b", "event_date": "2025-01-31"}, {"user_id": "b", "event_date": "2025-01-31"},
    )
    assert rows(activity.stickiness_dau_mau(events)) == [
        {"year_month": "2025-01", "avg_dau": 1.5, "mau": 2, "stickiness_pct": 75.0}
    ]
    assert rows(growth.monthly_growth_table(events))[0]["avg_dau"] == 1.5


def test_filter_scope_of_retention(make_events):
    """The filter picks the users and their first date; later activity counts in full."""
    events = make_events(
        {"user_id": "a", "event_date": "2025-01-01", "device_type": "Tablet"},
        {"user_id": "a", "event_date": "2025-01-02"},
        {"user_id": "a", "event_date": "2025-01-03", "device_type": "Tablet"},
        {"user_id": "b", "event_date": "2025-01-02"},
        {"user_id": "c", "event_date": "2025-01-02", "device_type": "Tablet"},
    )
    mobile = EventFilters(devices=("Mobile",))
    assert rows(retention.retention_overall_rate(events, mobile)) == [
        {"total_users": 2, "returning_users": 1, "retention_rate_pct": 50.0}
    ]
    dates = {(r["user_id"], r["cohort_date"].day, r["event_date"].day)
             for r in rows(retention.user_first_and_activity_dates(events, mobile))}
    assert dates == {("a", 2, 1), ("a", 2, 2), ("a", 2, 3), ("b", 2, 2)}
    cohorts = rows(retention.cohort_table(events, mobile))
    assert cohorts[0]["cohort_size"] == 2 and cohorts[0]["Day 1"] == 50.0


def test_null_user_counts_once_but_never_returns(make_events):
    events = make_events({"user_id": None}, {"user_id": None, "event_date": "2025-01-09"}, {"user_id": "a"})
    assert rows(retention.retention_overall_rate(events)) == [
        {"total_users": 2, "returning_users": 0, "retention_rate_pct": 0.0}
    ]
    assert rows(activity.dau(events))[0]["dau"] == 1


def test_matrix_scope_and_null_country(make_events):
    events = make_events(
        {"country": "A", "paid": "10"}, {"country": "A", "device_type": "Tablet", "paid": "99"},
        {"country": None, "paid": "50"}, {"country": "B", "device_type": "Tablet", "paid": "70"},
    )
    mobile = EventFilters(devices=("Mobile",))
    cells = {(r["country"], r["device_type"]): r["revenue"] for r in rows(breakdowns.country_device_matrix(events, mobile))}
    assert cells == {("A", "Mobile"): 10.0, ("A", "Tablet"): 99.0}
    # the null country takes the only place and has no rows
    assert rows(breakdowns.country_device_matrix(events, mobile, n=1)) == []


def test_null_group_is_kept(make_events):
    events = make_events({"country": None, "paid": "5"}, {"country": "A"})
    table = {r["country"]: r for r in rows(breakdowns.revenue_by_country(events))}
    assert table[None]["revenue"] == 5.0 and table["A"]["arpu"] == 0.0
    sources = rows(breakdowns.traffic_source_analysis(make_events({"traffic_source": None}, {"traffic_source": "X"})))
    assert {r["traffic_source"]: r["sessions"] for r in sources} == {None: 1, "X": 1}


def test_sessions_are_counted_across_users(make_events):
    events = make_events({"user_id": "a", "session_id": "s"}, {"user_id": "b", "session_id": "s"}, {"session_id": "t"})
    assert rows(revenue.kpi_snapshot(events))[0]["total_sessions"] == 2
    assert rows(breakdowns.device_breakdown(events))[0]["sessions"] == 2


@pytest.mark.parametrize("name", NAMED_QUERIES)
def test_no_events(make_events, name):
    table = NAMED_QUERIES[name](make_events())
    one_row = {
        "arpu_overall", "revenue_per_session", "purchase_frequency", "retention_overall_rate",
        "session_duration_stats", "sessions_per_user", "kpi_snapshot",
    }
    assert table.count() == (1 if name in one_row else 4 if name == "funnel" else 0)


def test_monthly_revenue_adds_up(make_events):
    events = make_events(*[{"event_date": f"2025-0{1 + i % 3}-1{i % 9}", "paid": f"{i}.{i:02d}"} for i in range(40)])
    daily = sum(r["revenue"] for r in rows(revenue.revenue_trend(events)))
    monthly = sum(r["total_revenue"] for r in rows(revenue.monthly_revenue(events)))
    assert daily == pytest.approx(monthly) == pytest.approx(rows(revenue.kpi_snapshot(events))[0]["total_revenue"])


def test_first_value_is_by_time(make_events):
    from datetime import datetime

    events = make_events(
        {"user_id": "a", "subscription": "Free", "event_timestamp": datetime(2025, 1, 1, 9)},
        {"user_id": "a", "subscription": "Annual", "event_timestamp": datetime(2025, 1, 1, 8)},
        {"user_id": "b", "subscription": "Monthly", "event_timestamp": datetime(2025, 1, 1, 8)},
        {"user_id": "b", "subscription": "Free", "event_timestamp": datetime(2025, 1, 1, 8)},
    )
    assert rows(retention.users_by_first_value(events, "subscription")) == [
        {"subscription": "Annual", "users": 1}, {"subscription": "Free", "users": 1}
    ]


def test_heatmap_has_all_days(make_events):
    events = make_events({"retention_day": 0}, {"retention_day": 60, "event_date": date(2025, 1, 9)}, {"retention_day": None})
    assert [tuple(r) for r in retention.retention_heatmap(events).collect()] == [
        ("2024-12-30/2025-01-05", 0, 1), ("2024-12-30/2025-01-05", 60, 0),
        ("2025-01-06/2025-01-12", 0, 0), ("2025-01-06/2025-01-12", 60, 1),
    ]
    assert rows(retention.retention_heatmap(events.limit(0))) == []
