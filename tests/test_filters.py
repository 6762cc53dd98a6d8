from __future__ import annotations

from datetime import date

import pytest
from conftest import rows

from eventloom.filters import EventFilters, date_bounds, filter_options


def test_bounds_are_inclusive_and_lists_combine(make_events):
    events = make_events(
        {"event_date": "2025-01-01", "country": "India"},
        {"event_date": "2025-01-02", "country": "India"},
        {"event_date": "2025-01-03", "country": "Brazil"},
        {"event_date": "2025-01-03", "country": "India", "device_type": "Tablet"},
        {"event_date": "2025-01-04", "country": "India"},
    )
    chosen = EventFilters.from_dict(
        {"start_date": "2025-01-02", "end_date": "2025-01-03", "countries": ["India"], "devices": ["Mobile", "Tablet"]}
    )
    assert sorted(r["user_id"] for r in rows(chosen.apply(events))) == ["u1", "u3"]
    assert EventFilters().apply(events).count() == 5
    assert EventFilters.from_dict({"countries": []}).apply(events).count() == 5


def test_null_is_never_in_a_list(make_events):
    events = make_events({"country": None}, {"country": "India"})
    assert EventFilters(countries=("India",)).apply(events).count() == 1


def test_selection():
    made = EventFilters.from_selection({"date_range": (date(2025, 1, 1), date(2025, 1, 31)), "campaigns": ["A"], "devices": []})
    assert made == EventFilters(date(2025, 1, 1), date(2025, 1, 31), campaigns=("A",))
    assert EventFilters.from_selection({"date_range": (date(2025, 1, 1),)}) == EventFilters()


@pytest.mark.parametrize("days", [1, 7, 31])
def test_previous_period_has_equal_length_and_touches(days):
    start = date(2025, 3, 1)
    now = EventFilters(start, date.fromordinal(start.toordinal() + days - 1), countries=("India",))
    before = now.previous_period()
    assert (before.end_date - before.start_date) == (now.end_date - now.start_date)
    assert (start - before.end_date).days == 1
    assert before.countries == ("India",)
    assert EventFilters(start_date=start).previous_period() is None


def test_options_and_bounds(make_events):
    events = make_events({"country": "B", "event_date": "2025-01-05"}, {"country": None}, {"country": "A"}, {"country": "B"})
    countries = [r["value"] for r in rows(filter_options(events)) if r["dimension"] == "country"]
    assert countries == ["A", "B"]
    assert rows(date_bounds(events)) == [{"min_date": date(2025, 1, 1), "max_date": date(2025, 1, 5)}]
