"""Everything a dashboard page shows for one selection, as lazy tables.

A caller runs only the tables it shows. Events should be a written table, see
``eventloom.sources.tables``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import cache, partial
from typing import Any

from pyspark.sql import DataFrame

from eventloom.filters import EventFilters, date_bounds, filter_options
from eventloom.operators import (
    activity,
    anomaly,
    breakdowns,
    chart_data,
    distribution,
    funnel,
    growth,
    insights,
    kpis,
    retention,
    revenue,
    rfm,
    segments,
)
from eventloom.session import durable
from eventloom.sources import outputs



class LazyTables(Mapping):
    """Tables by name, each made when it is first asked for; making the mapping runs nothing."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


SUMMARY_DIMENSIONS = ("country", "campaign", "device_type", "subscription", "traffic_source")


def overview(events: DataFrame, selection: Mapping[str, Any]) -> LazyTables:
    """Filter lists, KPIs, chart data, texts and summary tables."""
    filters = EventFilters.from_selection(selection)
    chosen = filters.apply(events)
    makers: dict[str, Callable[[], DataFrame]] = {
        "filter_options": lambda: filter_options(events),
        "date_bounds": lambda: date_bounds(events),
        "kpis": lambda: kpis.dashboard_kpis(chosen),
        "advanced_kpis": lambda: kpis.advanced_kpis(chosen),
        "period_comparison": lambda: kpis.period_comparison(events, filters),
        "executive_summary": lambda: insights.executive_summary(events, filters),
        "revenue_trend": lambda: revenue.revenue_trend(chosen),
        "dau_trend": lambda: chart_data.dau_smoothed(chosen),
        "revenue_by_country": lambda: chart_data.revenue_by(chosen, "country"),
        "revenue_by_device": lambda: chart_data.revenue_by(chosen, "device_type", earning_only=True),
        "campaign_performance": lambda: chart_data.revenue_by(chosen, "campaign", ascending=True),
        "traffic_sources": lambda: chart_data.events_by(chosen, "traffic_source"),
        "subscriptions": lambda: chart_data.subscription_users(chosen),
        "retention_heatmap": lambda: retention.retention_heatmap(chosen),
        "duration_histogram": lambda: distribution.duration_histogram(chosen),
        "duration_density": lambda: distribution.duration_density(chosen),
        "funnel": lambda: funnel.stage_users(chosen),
        "insights": lambda: insights.live_insights(chosen),
        "recommendations": lambda: insights.recommendations(events, filters),
        "monthly_growth": lambda: growth.monthly_growth_table(chosen),
        "summary_metrics": lambda: kpis.filtered_summary_metrics(chosen),
        "campaign_summary": lambda: segments.segment_summary(chosen, "campaign"),
        "device_summary": lambda: segments.segment_summary(chosen, "device_type"),
    }
    for dimension in SUMMARY_DIMENSIONS:
        makers[f"{dimension}_table"] = partial(segments.summary_table, chosen, dimension)
    return LazyTables(makers)


def analytics_center(events: DataFrame, selection: Mapping[str, Any]) -> LazyTables:
    """Growth, comparisons, top lists, cohorts, segments and warnings.

    Asking for a segment table runs jobs, see ``rfm``.
    """
    filters = EventFilters.from_selection(selection)
    cohorts = retention.cohort_table(events, filters)

    @cache
    def scored() -> DataFrame:
        return rfm.rfm_table(events, filters)

    @cache
    def segment_table() -> DataFrame:
        return rfm.rfm_segment_summary(scored())

    countries = breakdowns.revenue_by_country(events, filters)

    @cache
    def cards() -> DataFrame:
        return anomaly.warning_report(events, filters)

    return LazyTables({
        "kpi_cards": lambda: kpis.kpi_cards(events, filters),
        "kpi_snapshot": lambda: revenue.kpi_snapshot(events, filters),
        "monthly_growth": lambda: growth.monthly_growth(events, filters),
        "weekly_growth": lambda: growth.weekly_growth(events, filters),
        "top_campaign_growth": lambda: growth.top_campaign_growth(events, filters),
        "countries": lambda: countries,
        "leading_countries": lambda: countries.limit(10),
        "devices": lambda: breakdowns.revenue_by_device(events, filters),
        "subscriptions": lambda: breakdowns.subscription_analysis(events, filters),
        "traffic_sources": lambda: breakdowns.traffic_source_analysis(events, filters),
        "top_campaigns": lambda: breakdowns.top_campaigns(events, filters),
        "top_countries": lambda: breakdowns.top_countries(events, filters),
        "top_cities": lambda: breakdowns.top_cities(events, filters),
        "funnel": lambda: funnel.funnel(events, filters),
        "revenue_trend": lambda: revenue.revenue_trend(events, filters),
        "event_volume": lambda: activity.daily_event_volume(events, filters),
        "cohorts": lambda: cohorts,
        "cohort_cells": lambda: retention.cohort_cells(cohorts),
        "cohort_insights": lambda: retention.cohort_insights(cohorts),
        "rfm": scored,
        "rfm_segments": segment_table,
        "warnings": lambda: anomaly.shown_cards(cards()),
        "report_insights": lambda: insights.report_insights(events, segment_table(), filters),
        "report_advice": lambda: insights.report_advice(events),
    })


def live_report(events: DataFrame, selection: Mapping[str, Any]) -> LazyTables:
    """The text and JSON documents of the current selection, both from one row of facts that is computed once."""
    filters = EventFilters.from_selection(selection)

    @cache
    def facts() -> DataFrame:
        return durable(insights.live_facts_of(kpis.cube_of(events, filters), kpis.COMPARED))

    def text() -> DataFrame:
        return outputs.live_document(insights.insights_from(facts()), insights.recommendations_from(facts()))

    def json() -> DataFrame:
        previous = facts().where("earlier.total_users IS NOT NULL").select(*[f"earlier.{name}" for name in kpis.COMPARED])
        return outputs.json_report(
            facts().select(*kpis.COMPARED),
            kpis.advanced_of(facts()),
            previous if filters.previous_period() is not None else None,
            insights.insights_from(facts()),
            insights.recommendations_from(facts()),
        )

    return LazyTables({"text": text, "json": json})
