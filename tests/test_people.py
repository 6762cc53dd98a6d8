"""RFM, anomalies, distributions, KPIs and texts against plain Python."""

from __future__ import annotations

import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from eventloom.filters import EventFilters
from eventloom.operators import anomaly, distribution, insights, kpis, retention, rfm, segments
from eventloom.wording import ADVICE, COHORT_TEXT, LIVE_INSIGHTS


def quintiles(values: list, users: list) -> dict:
    """Scores as pandas gives them for users in id order."""
    table = pd.Series(values, index=users).sort_index()
    if len(table) < 2:
        return {user: 3 for user in users}
    return pd.qcut(table.rank(method="first"), 5, labels=[1, 2, 3, 4, 5]).astype(int).to_dict()


@pytest.mark.parametrize("users", [1, 2, 3, 7, 11, 60, 403])
def test_scores_match_quantile_cuts(make_events, users):
    rng = random.Random(users)
    made = []
    for i in range(users):
        for s in range(rng.randrange(1, 4)):
            # a third of the users never pays: one value shared by many
            paid = "0" if i % 3 == 0 else str(rng.randrange(1, 40))
            day = date(2025, 1, 1) + timedelta(days=rng.randrange(20))
            made.append({"user_id": f"u{i}", "session_id": f"s{i}-{s}", "event_date": day, "paid": paid})
    table = rows(rfm.rfm_table(make_events(*made)))
    ids = [r["user_id"] for r in table]
    assert len(ids) == users == len(set(ids))
    recency = quintiles([r["recency_days"] for r in table], ids)
    frequency = quintiles([r["frequency"] for r in table], ids)
    monetary = quintiles([r["monetary"] for r in table], ids)
    for r in table:
        assert (r["R"], r["F"], r["M"]) == (6 - recency[r["user_id"]], frequency[r["user_id"]], monetary[r["user_id"]])


def test_segments_and_snapshot(make_events):
    events = make_events({"user_id": "a", "event_date": "2025-01-10"})
    row = rows(rfm.rfm_table(events, snapshot_date=date(2025, 1, 31)))[0]
    assert (row["recency_days"], row["R"], row["F"], row["M"], row["rfm_segment"]) == (21, 3, 3, 3, "Loyal Customers")
    assert rows(rfm.rfm_table(make_events())) == []


@pytest.mark.parametrize(
    ("scores", "name"),
    [
        ((5, 4, 4), "Champions"), ((4, 3, 4), "Loyal Customers"), ((3, 1, 3), "Potential Loyalists"),
        ((2, 2, 2), "Need Attention"), ((1, 5, 5), "At Risk"), ((5, 1, 1), "Lost Customers"), ((2, 1, 2), "Lost Customers"),
    ],
)
def test_segment_names(spark, scores, name):
    columns = [F.lit(s) for s in scores]
    assert spark.range(1).select(rfm.segment_name(*columns)).first()[0] == name


def test_zscore_limits(spark):
    def found(values):
        table = spark.createDataFrame(list(enumerate(values)), "i int, v double")
        return rows(anomaly.zscore_anomalies(table, "v", ["i"]))

    assert found([1.0, 1.0, 1.0, 99.0]) == []  # four points
    assert found([7.0] * 9) == []  # no spread
    spike = found([10.0, 11.0, 9.0, 10.0, 10.0, 9.0, 11.0, 60.0])
    assert [(r["i"], r["direction"]) for r in spike] == [(7, "spike")]
    values = np.array([10.0, 11.0, 9.0, 10.0, 10.0, 9.0, 11.0, 60.0])
    assert spike[0]["z_score"] == np.round((60 - values.mean()) / values.std(), 2)


def test_warning_cards(make_events):
    quiet = rows(anomaly.warning_cards(make_events({"paid": "1"})))
    assert [r["severity"] for r in quiet] == ["info"]
    days = [{"event_date": date(2025, 1, 1) + timedelta(days=i), "paid": "10"} for i in range(20)]
    loud = rows(anomaly.warning_cards(make_events(*days, {"event_date": "2025-02-01", "paid": "500"})))
    assert loud[0]["title"] == "Revenue spike on 2025-02-01" and loud[0]["severity"] == "high"
    assert loud[0]["message"].startswith("Daily revenue of 500.00 is +")


def test_histogram_and_density_match_numpy(make_events):
    rng = random.Random(3)
    values = [rng.randrange(10, 500) for _ in range(300)]
    events = make_events(*[{"session_duration": v} for v in values])
    bins = rows(distribution.duration_histogram(events))
    counts, edges = np.histogram(values, bins=40)
    assert [b["events"] for b in bins] == counts.tolist()
    assert [b["lower"] for b in bins] == pytest.approx(edges[:-1].tolist())
    curve = rows(distribution.duration_density(events))
    data = np.array(values, dtype=float)
    width = 1.06 * data.std(ddof=1) * len(data) ** (-1 / 5)
    grid = np.linspace(data.min(), data.max(), 200)
    expected = np.exp(-0.5 * ((grid[:, None] - data) / width) ** 2).sum(axis=1) / (len(data) * width * np.sqrt(2 * np.pi))
    assert [p["density"] for p in curve] == pytest.approx(expected.tolist())


def test_flat_durations(make_events):
    events = make_events({"session_duration": 60}, {"session_duration": 60})
    bins = rows(distribution.duration_histogram(events))
    assert len(bins) == 40 and sum(b["events"] for b in bins) == 2
    assert [p["density"] for p in rows(distribution.duration_density(events))] == [0.0] * 200
    none = rows(distribution.duration_density(events.limit(0)))
    assert [p["density"] for p in none] == [0.0] * 200 and (none[0]["x"], none[-1]["x"]) == (0.0, 1.0)


def test_kpis_of_nothing_are_zero(make_events):
    nothing = make_events()
    for name, value in rows(kpis.dashboard_kpis(nothing))[0].items():
        assert value == 0, name
    advanced = rows(kpis.advanced_kpis(nothing))[0]
    assert (advanced["stickiness"], advanced["top_country"], advanced["top_device"]) == (0.0, "N/A", "N/A")
    assert [r["text"] for r in rows(insights.live_insights(nothing))] == [LIVE_INSIGHTS["empty"]]
    assert [r["text"] for r in rows(insights.recommendations(nothing))] == [ADVICE["empty"]]
    assert [r["text"] for r in rows(retention.cohort_insights(retention.cohort_table(nothing)))] == [COHORT_TEXT["none"]]
    assert rows(segments.summary_table(nothing, "country")) == []


def test_kpis_by_hand(make_events):
    events = make_events(
        {"user_id": "a", "event_date": "2025-01-01", "user_type": "Returning", "paid": "30"},
        {"user_id": "a", "event_date": "2025-01-02", "user_type": "Returning"},
        {"user_id": "b", "event_date": "2025-01-02", "session_id": "s2", "session_duration": 120},
        {"user_id": "b", "event_date": "2025-02-01", "session_id": "s3", "paid": "0"},
    )
    row = rows(kpis.batch_kpis(events))[0]
    assert row["total_users"] == 2 and row["total_sessions"] == 3 and row["total_events"] == 4
    assert row["avg_dau"] == pytest.approx(4 / 3) and row["avg_mau"] == 1.5
    assert (row["paying_users"], row["arppu"], row["avg_purchase_value"]) == (1, 30.0, 30.0)
    assert (row["conversion_rate_pct"], row["purchase_rate_pct"], row["returning_user_pct"]) == (50.0, 50.0, 50.0)
    assert row["median_session_duration"] == 60.0


def test_comparison_without_history(make_events):
    events = make_events({"event_date": "2025-01-01", "paid": "10"})
    table = rows(kpis.period_comparison(events, EventFilters(date(2025, 1, 1), date(2025, 1, 1))))
    assert len(table) == 10 and all(r["previous"] is None and r["direction"] is None for r in table)
    assert all(r["previous"] is None for r in rows(kpis.period_comparison(events, EventFilters())))


def test_comparison_directions(make_events):
    events = make_events(
        {"user_id": "a", "event_date": "2025-01-01", "paid": "10"}, {"user_id": "a", "event_date": "2025-01-02", "paid": "15"}
    )
    table = {r["metric"]: r for r in rows(kpis.period_comparison(events, EventFilters(date(2025, 1, 2), date(2025, 1, 2))))}
    assert (table["revenue"]["change_pct"], table["revenue"]["direction"]) == (50.0, "up")
    assert (table["total_users"]["change_pct"], table["total_users"]["direction"]) == (0.0, "flat")


def test_ties_go_to_the_first_name(make_events):
    events = make_events({"country": "B", "paid": "5"}, {"country": "A", "paid": "5"})
    assert rows(kpis.advanced_kpis(events))[0]["top_country"] == "A"


def test_recommendation_rules(make_events):
    events = make_events(
        {"user_id": "a", "event_date": "2025-01-01", "campaign": "X", "paid": "100"},
        {"user_id": "a", "event_date": "2025-01-02", "campaign": "X", "paid": "40"},
        {"user_id": "b", "event_date": "2025-01-02", "campaign": "Y", "device_type": "Desktop", "paid": "10"},
        {"user_id": "c", "event_date": "2025-01-02", "device_type": "Desktop"},
    )
    said = [r["text"] for r in rows(insights.recommendations(events, EventFilters(date(2025, 1, 2), date(2025, 1, 2))))]
    assert said[0] == ADVICE["revenue_down"].replace("%s", "50.0", 1).replace("%%", "%")
    assert any("'X' generates 80.0% of attributed" in line for line in said)
    assert any("'Y' is the weakest" in line for line in said)
    assert any(line.startswith("📱 Mobile users convert at the highest rate (100.0%)") for line in said)
    # one user fewer after the first stage: no purchase path, so the step to Search loses all
    assert any("(100.0%) happens between 'App Open' and 'Search'" in line for line in said)


def test_segment_share_adds_to_a_hundred(make_events):
    events = make_events(*[{"country": c, "paid": "7.5"} for c in "ABCAB"])
    assert sum(r["pct_share"] for r in rows(segments.summary_table(events, "country"))) == pytest.approx(100.0)
