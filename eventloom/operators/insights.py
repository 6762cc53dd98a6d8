"""Rule-based sentences over facts that Spark computes.

Each list starts from one row of facts and ends as rows ``(position, text)``.
The sentences are SQL over that row, one expression per list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.filters import EventFilters, select
from eventloom.functions.keys import weekday_name
from eventloom.functions.measures import one_row, summarise
from eventloom.functions.numbers import ratio
from eventloom.operators.breakdowns import revenue_by_country
from eventloom.operators.day_cube import DayCube
from eventloom.operators.kpis import (
    batch_kpis_of,
    batch_kpis_with_stages,
    cube_kpis_and_earlier,
    kpis_and_earlier,
    kpis_with_stages,
    median_duration,
)
from eventloom.operators.revenue import kpi_snapshot
from eventloom.operators.segments import leader, segment_totals, total_of
from eventloom.schema import FUNNEL_STAGES, NO_CAMPAIGN, UNKNOWN
from eventloom.wording import (
    ADVICE,
    BATCH_INSIGHTS,
    LIVE_INSIGHTS,
    NO_STICKINESS,
    REPORT_ADVICE,
    REPORT_TEXT,
    SUMMARY_LABELS,
)

LOW_STICKINESS = 20
CONVERSION_CHANGE = 1
MOST_ADVICE = 12

# Facts shared by several lists, over the columns of the KPI row and ``top``.
DROP_OFF = f"100 * (1 - try_divide(cast(stages[{len(FUNNEL_STAGES) - 1}] AS double), stages[0]))"
COUNTRY_SHARE = "try_divide(-100.0D * top.country.low, top.country_revenue)"
STICKINESS = "coalesce(try_divide(100.0D * dau, mau), 0D)"
RETURNING_PCT = "coalesce(try_divide(100.0D * returning, total_users), 0D)"


def _grouped(x: str, digits: int) -> str:
    return f"format_number({x}, {digits})"


def _fixed(x: str, digits: int) -> str:
    return f"translate(format_number({x}, {digits}), ',', '')"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _say(text: str, *values: str, when: str | None = None) -> str:
    """The sentence, or null where a value or the condition is missing."""
    needed = [f"{value} IS NOT NULL" for value in values] + ([f"({when})"] if when else [])
    sentence = f"format_string({', '.join([_quoted(text), *values])})"
    return f"CASE WHEN {' AND '.join(needed)} THEN {sentence} END" if needed else sentence


def _sentences(facts: DataFrame, sentences: Sequence[str], empty: str | None = None, most: int | None = None) -> DataFrame:
    said = f"array_compact(array({', '.join(sentences)}))"
    if most:
        said = f"slice({said}, 1, {most})"
    if empty:
        said = f"CASE WHEN total_events = 0 THEN array({_quoted(empty)}) ELSE {said} END"
    return facts.selectExpr(f"posexplode({said}) AS (at, text)").selectExpr("at + 1 AS position", "text")


def segment_facts(events: DataFrame) -> DataFrame:
    """One row: leaders and totals of every dimension the sentences mention."""
    dimensions = ["country", "device_type", "campaign", "traffic_source", "event_name", "subscription", "os", "city", "weekday"]
    return leaders(segment_totals(events.withColumn("weekday", weekday_name(F.col("event_date"))), dimensions))


def leaders(totals: DataFrame) -> DataFrame:
    """The leaders and totals in ``(dimension, segment, revenue, events)``, as one row."""
    paid = f"segment <> '{NO_CAMPAIGN}'"
    return totals.agg(
        leader("country", "revenue").alias("country"),
        total_of("country", "revenue").alias("country_revenue"),
        leader("device_type", "revenue").alias("device"),
        F.coalesce(leader("campaign", "revenue", paid), leader("campaign", "revenue")).alias("campaign"),
        leader("campaign", "revenue", paid).alias("paid_campaign"),
        total_of("campaign", "revenue", paid).alias("paid_campaign_revenue"),
        F.expr(f"max(struct(-revenue AS low, segment)) FILTER (WHERE dimension = 'campaign' AND {paid}) AS weakest_campaign"),
        leader("subscription", "revenue").alias("subscription"),
        leader("city", "revenue", f"segment <> '{UNKNOWN}'").alias("city"),
        leader("traffic_source", "events").alias("traffic"),
        leader("event_name", "events").alias("event"),
        leader("os", "events").alias("os"),
        leader("weekday", "events").alias("weekday"),
    )


def _name(spot: str) -> str:
    return f"top.{spot}.segment"


def _amount(spot: str, digits: int) -> str:
    return _grouped(f"-top.{spot}.low", digits)


def batch_facts(events: DataFrame) -> DataFrame:
    """One row with the KPIs of the batch report and the leaders that its lines name."""
    return batch_kpis_with_stages(events).select("*", one_row(segment_facts(events)).alias("top"))


def batch_facts_of(cube: DayCube) -> DataFrame:
    """``batch_facts`` read from a day cube."""
    return batch_kpis_of(cube).select("*", one_row(leaders(cube.segment_totals())).alias("top"))


def batch_insights(events: DataFrame) -> DataFrame:
    """The 24 lines of the batch report."""
    return batch_insights_from(batch_facts(events))


def batch_insights_from(facts: DataFrame) -> DataFrame:
    stickiness = "try_divide(100.0D * avg_dau, avg_mau)"
    values: list[tuple[str, ...]] = [
        (_name("country"), _amount("country", 2), _fixed(COUNTRY_SHARE, 1)),
        (_name("campaign"), _amount("campaign", 2)),
        (_name("device"), _amount("device", 2)),
        (_name("traffic"), _amount("traffic", 0)),
        (_fixed("avg_purchase_value", 2), _fixed("arppu", 2)),
        (_fixed("returning_user_pct", 1),),
        (_name("weekday"),),
        (_name("event"), _amount("event", 0)),
        (_name("subscription"), _amount("subscription", 2)),
        (_fixed("conversion_rate_pct", 2),),
        (_fixed("avg_session_duration", 1), _fixed("median_session_duration", 1)),
        (_name("traffic"),),
        (_name("campaign"),),
        (),
        (),
        (_fixed("purchase_rate_pct", 2),),
        (_name("os"), _amount("os", 0)),
        (_fixed("arpu", 2), _grouped("total_users", 0)),
        (f"coalesce({_name('city')}, 'N/A')",),
        (_fixed(f"coalesce({DROP_OFF}, 0D)", 1),),
        (_grouped("total_revenue", 2), _grouped("paying_users", 0), _grouped("total_users", 0)),
        (_fixed("avg_mau", 0), _fixed("avg_dau", 0), _fixed(stickiness, 1)),
        (),
        (),
    ]
    lines = [_say(text, *given) for text, given in zip(BATCH_INSIGHTS, values, strict=True)]
    lines[21] = f"coalesce({lines[21]}, {_quoted(NO_STICKINESS)})"
    return _sentences(facts, lines)


def live_facts(
    events: DataFrame, filters: EventFilters | None = None, earlier: Sequence[str] = ("revenue", "conversion_rate")
) -> DataFrame:
    """One row with all that the live texts and the advanced KPIs need; a text drops, unread, what it does not use."""
    chosen = select(events, filters)
    return kpis_and_earlier(events, filters, earlier).select(
        "*",
        one_row(segment_facts(chosen)).alias("top"),
        median_duration(chosen).scalar().alias("median"),
        _device_conversion(chosen).scalar().alias("device_rate"),
        _steepest_drop().alias("drop"),
    )


def live_facts_of(cube: DayCube, earlier: Sequence[str] = ("revenue", "conversion_rate")) -> DataFrame:
    """``live_facts`` read from a day cube of the selection and the period before."""
    return cube_kpis_and_earlier(cube, earlier).select(
        "*",
        one_row(leaders(cube.segment_totals())).alias("top"),
        cube.median_duration().scalar().alias("median"),
        cube.device_conversion().scalar().alias("device_rate"),
        _steepest_drop().alias("drop"),
    )


def live_insights(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    """Up to twelve lines about the filtered events."""
    chosen = select(events, filters)
    facts = kpis_with_stages(chosen).select(
        "*", one_row(segment_facts(chosen)).alias("top"), median_duration(chosen).scalar().alias("median")
    )
    return insights_from(facts)


def insights_from(facts: DataFrame) -> DataFrame:
    def earning(spot: str) -> str:
        return f"top.{spot}.low < 0"

    say = LIVE_INSIGHTS
    lines = [
        _say(say["country"], _name("country"), _amount("country", 2), _fixed(COUNTRY_SHARE, 1), when=earning("country")),
        _say(say["device"], _name("device"), _amount("device", 2), when=earning("device")),
        _say(say["campaign"], _name("campaign"), _amount("campaign", 2), when=earning("campaign")),
        _say(say["traffic"], _name("traffic"), _amount("traffic", 0)),
        _say(say["event"], _name("event"), _amount("event", 0)),
        _say(say["subscription"], _name("subscription"), _amount("subscription", 2), when=earning("subscription")),
        _say(say["users"], _grouped("total_users", 0), _grouped("revenue", 2), _fixed("arpu", 2)),
        _say(say["conversion"], _fixed("conversion_rate", 2), _fixed("avg_purchase_value", 2)),
        _say(say["activity"], _fixed("dau", 0), _fixed("mau", 0)),
        _say(say["funnel"], _fixed(DROP_OFF, 1), _quoted(FUNNEL_STAGES[0]), _quoted(FUNNEL_STAGES[-1])),
        _say(say["returning"], _fixed(RETURNING_PCT, 1), when="returning > 0"),
        _say(say["duration"], _fixed("avg_session_duration", 1), _fixed("median", 1)),
    ]
    return _sentences(facts, lines, empty=say["empty"])


def _device_conversion(events: DataFrame) -> DataFrame:
    """One row: the device with the largest share of purchasing users."""
    devices = summarise(events.where(F.col("device_type").isNotNull()), "device_type")
    bought = devices.where(F.col("converters") > 0)
    rate = ratio(F.col("converters"), F.col("users")) * 100
    return bought.agg(F.min(F.struct((-rate).alias("low"), F.col("device_type").alias("segment"))))


def _steepest_drop() -> Column:
    """``(low, step, from, to)`` of the largest loss between neighbouring stages; null if none."""
    steps = []
    for i in range(1, len(FUNNEL_STAGES)):
        drop = f"100 * (1 - try_divide(cast(stages[{i}] AS double), stages[{i - 1}]))"
        names = f"{_quoted(FUNNEL_STAGES[i - 1])} AS before, {_quoted(FUNNEL_STAGES[i])} AS after"
        steps.append(f"CASE WHEN {drop} > 0 THEN struct(-({drop}) AS low, {i} AS step, {names}) END")
    return F.expr(f"array_min(array({', '.join(steps)}))")


def recommendations(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    """Up to twelve next steps; growth rules need a previous period with events."""
    return recommendations_from(live_facts(events, filters))


def recommendations_from(facts: DataFrame) -> DataFrame:
    revenue = "(100.0D * try_divide(revenue - earlier.revenue, earlier.revenue))"
    conversion = "(100.0D * try_divide(conversion_rate - earlier.conversion_rate, earlier.conversion_rate))"
    best_share = "try_divide(-100.0D * top.paid_campaign.low, top.paid_campaign_revenue)"
    paid = "top.paid_campaign_revenue > 0"
    several = f"{paid} AND {_name('weakest_campaign')} <> {_name('paid_campaign')}"
    say = ADVICE
    lines = [
        _say(say["revenue_up"], _fixed(revenue, 1), when=f"{revenue} > 0"),
        _say(say["revenue_down"], _fixed(f"abs({revenue})", 1), when=f"{revenue} <= 0"),
        _say(say["conversion_down"], _fixed(f"abs({conversion})", 1), when=f"{conversion} < -{CONVERSION_CHANGE}"),
        _say(say["conversion_up"], _fixed(conversion, 1), when=f"{conversion} > {CONVERSION_CHANGE}"),
        _say(say["campaign_best"], _name("paid_campaign"), _fixed(best_share, 1), when=paid),
        _say(say["campaign_worst"], _name("weakest_campaign"), when=several),
        _say(say["country"], _name("country"), _fixed(COUNTRY_SHARE, 1), when="top.country_revenue > 0"),
        _say(say["device"], "device_rate.segment", _fixed("-device_rate.low", 1)),
        _say(say["returning"], _fixed(RETURNING_PCT, 1), when="returning > 0 AND earlier.revenue IS NOT NULL"),
        _say(say["funnel"], _fixed("-drop.low", 1), "drop.before", "drop.after"),
        _say(say["subscription"], _name("subscription"), when="top.subscription.low < 0"),
        _say(say["stickiness_low"], _fixed(STICKINESS, 1), when=f"{STICKINESS} < {LOW_STICKINESS}"),
        _say(say["stickiness_ok"], _fixed(STICKINESS, 1), when=f"{STICKINESS} >= {LOW_STICKINESS}"),
        _say(say["traffic"], _name("traffic")),
    ]
    return _sentences(facts, lines, empty=say["empty"], most=MOST_ADVICE)


def executive_summary(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    """Nine rows ``(position, label, value)``."""
    facts = live_facts(events, filters)

    def earner(spot: str) -> str:
        return f"CASE WHEN top.{spot}.low < 0 THEN {_name(spot)} END"

    growth = _fixed("100.0D * try_divide(revenue - earlier.revenue, earlier.revenue)", 1)
    values = [
        f"concat(CASE WHEN {growth} LIKE '-%' THEN '' ELSE '+' END, {growth}, '%')",
        earner("country"),
        earner("campaign"),
        earner("device"),
        _name("traffic"),
        earner("subscription"),
        f"concat({_fixed(f'coalesce({DROP_OFF}, 0D)', 1)}, '%')",
        f"concat({_fixed(RETURNING_PCT, 1)}, '%')",
        f"concat({_fixed('avg_session_duration', 0)}, 's')",
    ]
    chips = ", ".join(
        f"struct({_quoted(label)} AS label, coalesce({value}, 'N/A') AS value)"
        for label, value in zip(SUMMARY_LABELS, values, strict=True)
    )
    return facts.selectExpr(f"posexplode(array({chips})) AS (at, chip)").selectExpr(
        "at + 1 AS position", "chip.label AS label", "chip.value AS value"
    )


def report_insights(events: DataFrame, segments: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    """Up to four lines; ``segments`` is the RFM segment summary."""
    best = revenue_by_country(events, filters).limit(1)
    champions = segments.where(F.col("rfm_segment") == "Champions").select("pct_of_total")
    facts = kpi_snapshot(events, filters).select(
        "*", one_row(best).alias("best"), champions.scalar().alias("champions")
    )
    lines = [
        _say(REPORT_TEXT["revenue"], _grouped("coalesce(total_revenue, 0D)", 2), _grouped("total_users", 0)),
        _say(REPORT_TEXT["arpu"], _grouped("coalesce(arpu, 0D)", 2), _fixed("coalesce(conversion_rate_pct, 0D)", 2)),
        _say(REPORT_TEXT["country"], "best.country", _grouped("best.revenue", 2)),
        _say(REPORT_TEXT["champions"], _fixed("champions", 1)),
    ]
    return _sentences(facts, lines)


def report_advice(events: DataFrame) -> DataFrame:
    lines = F.array(*[F.lit(text) for text in REPORT_ADVICE])
    listed = events.sparkSession.range(1).select(F.posexplode(lines).alias("at", "text"))
    return listed.select((F.col("at") + 1).alias("position"), "text")
