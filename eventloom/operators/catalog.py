"""The named queries, each ``(events, filters=None) -> DataFrame``."""

from __future__ import annotations

from pyspark.sql import DataFrame

from eventloom.filters import EventFilters
from eventloom.operators import activity, breakdowns, funnel, growth, retention, revenue

NAMED_QUERIES = {
    query.__name__: query
    for query in (
        activity.dau,
        activity.wau,
        activity.mau,
        activity.stickiness_dau_mau,
        revenue.revenue_trend,
        revenue.monthly_revenue,
        revenue.arpu_overall,
        revenue.revenue_per_session,
        revenue.purchase_frequency,
        breakdowns.revenue_by_country,
        breakdowns.revenue_by_device,
        breakdowns.revenue_by_campaign,
        breakdowns.revenue_by_traffic_source,
        breakdowns.revenue_by_subscription,
        funnel.funnel,
        activity.retention_by_day_bucket,
        retention.retention_overall_rate,
        breakdowns.returning_vs_new_users,
        growth.monthly_growth,
        growth.weekly_growth,
        growth.campaign_growth,
        breakdowns.top_countries,
        breakdowns.top_cities,
        breakdowns.top_campaigns,
        breakdowns.traffic_source_analysis,
        breakdowns.subscription_analysis,
        breakdowns.device_breakdown,
        breakdowns.os_breakdown,
        activity.session_duration_stats,
        activity.sessions_per_user,
        activity.event_frequency,
        breakdowns.app_version_breakdown,
        breakdowns.country_device_matrix,
        activity.level_progression,
        revenue.purchase_amount_distribution,
        activity.new_user_acquisition_trend,
        breakdowns.conversion_rate_by_country,
        breakdowns.campaign_efficiency,
        retention.user_level_aggregate,
        retention.user_first_and_activity_dates,
        breakdowns.campaign_device_performance,
        activity.daily_event_volume,
        revenue.kpi_snapshot,
        breakdowns.campaign_comparison,
    )
}


def run(name: str, events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    return NAMED_QUERIES[name](events, filters)
