"""The sentences and labels that reports are made of.

Every ``%s`` takes a value that is already formatted.
"""

from __future__ import annotations

# Lifecycle segments and what to do about them.
SEGMENT_ADVICE = {
    "Champions": "Reward with early access and loyalty perks; use as advocates/referrals.",
    "Loyal Customers": "Upsell higher tiers and subscriptions; keep engagement high with regular touchpoints.",
    "Potential Loyalists": "Offer onboarding nudges and limited-time incentives to build the habit.",
    "Need Attention": "Send re-engagement campaigns and personalized offers before they churn.",
    "At Risk": "Trigger win-back campaigns with discounts; investigate root cause of drop-off.",
    "Lost Customers": "Deprioritize spend; consider low-cost reactivation email only.",
}

COHORT_TEXT = {
    "none": "Not enough data to compute cohort retention.",
    "day_1": "Average Day 1 retention across cohorts is %s%%.",
    "day_30": "Average Day 30 retention across cohorts is %s%%.",
    "best": "The strongest cohort is %s with %s%% Day 30 retention.",
}

WARNING_TEXT = {
    "revenue": ("Revenue %s on %s", "Daily revenue of %s is %s std-devs from the mean."),
    "traffic": ("Traffic %s on %s", "Event volume of %s is %s std-devs from the mean."),
    "campaign": (
        "Campaign anomaly: %s (%s)",
        "Month-over-month revenue change of %s%% is unusual (z-score %s).",
    ),
    "retention": (
        "Retention anomaly: cohort %s",
        "Day 30 retention of %s%% is %s std-devs from other cohorts.",
    ),
    "none": (
        "No anomalies detected",
        "All key metrics are within normal statistical ranges for the current filter selection.",
    ),
}

BATCH_INSIGHTS = (
    "1. %s generates the highest revenue at $%s, representing %s%% of total revenue.",
    "2. '%s' is the highest performing marketing campaign, driving $%s in revenue.",
    "3. %s devices contribute the most revenue ($%s), suggesting the product experience is strongest on this platform.",
    "4. '%s' is the leading traffic source by event volume (%s events), making it the most valuable acquisition channel.",
    "5. The average purchase value across paying users is $%s, while ARPPU stands at $%s.",
    "6. Returning users make up %s%% of the user base, underscoring the importance of retention over pure acquisition.",
    "7. %s is the peak activity day of the week, an ideal window for push notifications and promotional campaigns.",
    "8. '%s' is the most frequent event overall (%s occurrences), indicating the core engagement loop.",
    "9. The '%s' subscription tier generates the most revenue ($%s), highlighting where monetization is concentrated.",
    "10. Overall conversion rate (users who purchased) is %s%%, leaving meaningful headroom for funnel optimization.",
    "11. Average session duration is %s seconds (median %ss), indicating typical engagement depth per visit.",
    "12. Growth recommendation: double down on paid and organic channels resembling '%s', since it already drives the highest engagement volume.",
    "13. Marketing recommendation: reallocate budget toward '%s'-style campaigns given its outsized revenue contribution relative to other campaigns.",
    "14. Product recommendation: investigate friction points between the 'Add to Cart' and 'Purchase' steps, since this is typically where the largest funnel drop-off occurs.",
    "15. Customer retention recommendation: launch a loyalty or win-back program targeting 'New' users, who convert to 'Returning' status at a lower rate than desired.",
    "16. The overall purchase event rate is %s%% of all logged events, suggesting purchase intent signals could be surfaced earlier in the user journey.",
    "17. %s is the dominant operating system among users (%s events), and should be prioritized for QA and performance testing.",
    "18. Average revenue per user (ARPU) is $%s across all %s users, a useful baseline for evaluating future feature launches.",
    "19. %s is the top revenue-generating city, indicating a geographic hotspot worth targeting with localized campaigns.",
    "20. From App Open to Purchase, the user funnel shows an overall drop-off of %s%%, highlighting the scale of the conversion opportunity.",
    "21. Total platform revenue stands at $%s generated by %s paying users out of %s total users.",
    "22. Monthly active users average %s, compared to a daily active user average of %s, giving an approximate stickiness (DAU/MAU) ratio of %s%%.",
    "23. Product recommendation: session durations are heavily right-skewed, so consider segmenting engagement analysis by session-length cohort rather than using averages alone.",
    "24. Marketing recommendation: campaigns with 'None' as their label represent organic, non-attributed revenue and should be excluded when judging paid-campaign ROI.",
)
NO_STICKINESS = "22. Insufficient data to compute stickiness ratio."
BATCH_INSIGHTS_TITLE = "PRODUCT ANALYTICS - AUTOMATED BUSINESS INSIGHTS"

LIVE_INSIGHTS = {
    "empty": "No events match the current filter selection.",
    "country": "🌍 %s leads revenue in the current selection at $%s (%s%% of filtered revenue).",
    "device": "📱 %s is the top-earning device type ($%s) among the filtered events.",
    "campaign": "🎯 '%s' is the strongest campaign in view, generating $%s.",
    "traffic": "🚦 '%s' drives the most events (%s) in the filtered slice.",
    "event": "⚡ '%s' is the most frequent event (%s occurrences) for this selection.",
    "subscription": "💳 The '%s' subscription tier contributes the most revenue ($%s) among filtered users.",
    "users": "👥 %s unique users generated $%s in revenue (ARPU $%s).",
    "conversion": "🔁 Conversion rate for this selection is %s%%, with an average purchase value of $%s.",
    "activity": "📊 Average DAU is %s and average MAU is %s across the filtered date range.",
    "funnel": "🔽 The funnel shows a %s%% drop-off from '%s' to '%s' for the current filters.",
    "returning": "🔄 Returning users make up %s%% of the currently filtered user base.",
    "duration": "⏱️ Average session duration in this view is %s seconds (median %ss).",
}

ADVICE = {
    "empty": "No data available for the current filter selection — widen filters to generate recommendations.",
    "revenue_up": "✅ Revenue is up %s%% vs. the previous period — sustain current spend allocation.",
    "revenue_down": "⚠️ Revenue is down %s%% vs. the previous period — investigate before the next budget cycle.",
    "conversion_down": "⚠️ Conversion rate declined %s%% — review onboarding and checkout friction.",
    "conversion_up": "✅ Conversion rate improved %s%% — identify and replicate what changed.",
    "campaign_best": "📢 '%s' generates %s%% of attributed campaign revenue — consider increasing its budget allocation.",
    "campaign_worst": "🔻 '%s' is the weakest attributed campaign — consider reallocating its budget.",
    "country": "🌍 %s contributes %s%% of revenue — prioritize localized campaigns and support for this market.",
    "device": "📱 %s users convert at the highest rate (%s%%) — prioritize this platform in product and creative testing.",
    "returning": "🔄 Returning users make up %s%% of the base — nurture this segment with loyalty or retention offers.",
    "funnel": "🔽 The steepest funnel drop-off (%s%%) happens between '%s' and '%s' — prioritize UX fixes at this step.",
    "subscription": "💳 The '%s' subscription tier drives the most revenue — consider upsell campaigns targeting lower tiers.",
    "stickiness_low": "📉 Stickiness (DAU/MAU) is only %s%% — invest in habit-forming features or push/notification re-engagement.",
    "stickiness_ok": "✅ Stickiness (DAU/MAU) is a healthy %s%%, indicating strong daily engagement relative to the monthly base.",
    "traffic": "🚦 '%s' drives the most traffic — validate attribution and double down if ROAS is favorable.",
}

REPORT_TEXT = {
    "revenue": "Total revenue for the current selection is %s across %s users.",
    "arpu": "ARPU stands at %s with a conversion rate of %s%%.",
    "country": "%s is the top-revenue market at %s.",
    "champions": "Champions make up %s%% of users but drive outsized revenue.",
}
REPORT_ADVICE = (
    "Prioritize retention campaigns for the At Risk and Need Attention RFM segments.",
    "Reallocate marketing spend toward the highest revenue-per-user campaigns.",
    "Investigate any flagged anomalies before the next reporting cycle.",
)

INSIGHTS_HEADING = "BUSINESS INSIGHTS"
ADVICE_HEADING = "EXECUTIVE RECOMMENDATIONS"

SUMMARY_LABELS = (
    "Revenue Growth",
    "Best Country",
    "Best Campaign",
    "Best Device",
    "Top Traffic Source",
    "Top Subscription (Revenue)",
    "Funnel Drop-off",
    "Returning Users",
    "Avg Session Duration",
)

CARD_LABELS = (
    "Total Users",
    "Total Revenue",
    "ARPU",
    "ARPPU",
    "Conversion Rate",
    "Avg Session (s)",
    "Total Sessions",
    "Total Events",
)
