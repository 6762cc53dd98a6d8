"""Points of a series that lie far from its mean."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.filters import EventFilters
from eventloom.functions.keys import month_key, month_start
from eventloom.functions.measures import money
from eventloom.functions.numbers import fixed, half_even, signed
from eventloom.operators.active_days import PER_MONTH, marked, month_columns, user_calendars
from eventloom.operators.activity import daily_event_volume
from eventloom.operators.growth import campaign_growth, campaign_growth_of
from eventloom.operators.retention import cohorts_of
from eventloom.operators.revenue import revenue_trend
from eventloom.session import durable
from eventloom.wording import WARNING_TEXT

# Fixed values.
Z_THRESHOLD = 2.0
HIGH_Z = 3.0
MIN_POINTS = 5
CARDS_SHOWN = 20


def zscore_anomalies(series: DataFrame, value: str, labels: list[str], threshold: float = Z_THRESHOLD) -> DataFrame:
    """Rows at least ``threshold`` population standard deviations from the mean.

    Nothing is reported for fewer than five points or a constant series.
    """
    number = F.col(value).cast("double")
    stats = series.agg(
        F.count(F.lit(1)).alias("points"), F.avg(number).alias("mean"), F.stddev_pop(number).alias("spread")
    )
    z = F.try_divide(number - F.col("stats.mean"), F.col("stats.spread"))
    return (
        series.select(*labels, value, stats.select(F.struct("*")).scalar().alias("stats"))
        .where((F.col("stats.points") >= MIN_POINTS) & (F.abs(z) >= threshold))
        .select(*labels, value, half_even(z, 2).alias("z_score"), F.when(z > 0, "spike").otherwise("drop").alias("direction"))
        .orderBy(F.abs("z_score").desc(), *labels)
    )


def revenue_anomalies(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    return zscore_anomalies(revenue_trend(events, filters), "revenue", ["date"])


def traffic_anomalies(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    return zscore_anomalies(daily_event_volume(events, filters), "event_count", ["date", "active_users"])


def campaign_anomalies(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    return _growth_anomalies(campaign_growth(events, filters))


def _growth_anomalies(growth: DataFrame) -> DataFrame:
    return zscore_anomalies(growth.where(F.col("revenue_growth_pct").isNotNull()), "revenue_growth_pct", ["campaign", "year_month"])


def retention_anomalies(cohorts: DataFrame) -> DataFrame:
    return zscore_anomalies(cohorts.where(F.col("Day 30").isNotNull()), "Day 30", ["cohort_month", "cohort_size"])


def _cards(rows: DataFrame, kind: str, severity: Column, title: list[Column], message: list[Column], key: Column) -> DataFrame:
    title_text, message_text = WARNING_TEXT[kind]
    return rows.select(
        F.lit(list(WARNING_TEXT).index(kind)).alias("kind"),
        F.abs("z_score").alias("size"),
        key.alias("key"),
        severity.alias("severity"),
        F.format_string(title_text, *title).alias("title"),
        F.format_string(message_text, *message).alias("message"),
    )


class Detectors:
    """The series of all detectors, from one pass over the events.

    Grouping sets reduce the events at once by day, by campaign and month, and,
    where retention is wanted, by user and month (``active_days``). Rows of a set
    are told by which keys they have; the sets are written once and each
    detector reads its own. Making this runs a job.
    """

    DAY, CAMPAIGN, USER = 0b0111, 0b1001, 0b1100  # grouping_id: a bit for each key left out, of day, campaign, month, user

    def __init__(self, events: DataFrame, filters: EventFilters | None = None, users: bool = False):
        keys = ["event_date", "campaign", "month", "user_id"]
        rows = marked(events, filters)
        sets = [["event_date"], ["campaign", "month"]]
        if users:
            sets.append(["month", "user_id"])
        else:
            rows = rows.where("chosen")  # only users count outside the filter
        rows = rows.select(*keys, "chosen", money().alias("amount"))
        self.rows = durable(
            rows.groupingSets(sets, *keys).agg(
                F.grouping_id().alias("set"),
                F.count_if("chosen").alias("events"),
                F.sum(F.when(F.col("chosen"), F.col("amount"))).alias("revenue"),
                *(month_columns() if users else []),
            )
        )

    def _series(self, which: int) -> DataFrame:
        found = self.rows.where((F.col("set") == which) & (F.col("events") > 0))
        return found.withColumn("revenue", F.col("revenue").cast("double"))

    def revenue(self) -> DataFrame:
        return zscore_anomalies(self._series(self.DAY).withColumnRenamed("event_date", "date"), "revenue", ["date"])

    def traffic(self) -> DataFrame:
        days = self._series(self.DAY).select(F.col("event_date").alias("date"), F.col("events").alias("event_count"))
        return zscore_anomalies(days, "event_count", ["date"])

    def campaigns(self) -> DataFrame:
        months = self._series(self.CAMPAIGN)
        key = month_key(month_start(F.col("month"))).alias("year_month")
        return _growth_anomalies(campaign_growth_of(months.select("campaign", key, "revenue")))

    def cohorts(self) -> DataFrame:
        months = self.rows.where((F.col("set") == self.USER) & F.col("user_id").isNotNull())
        return cohorts_of(user_calendars(months.select("user_id", "month", *PER_MONTH)))


def warning_report(events: DataFrame, filters: EventFilters | None = None) -> DataFrame:
    """The cards of all four detectors; the events are read once, when this is called."""
    found = Detectors(events, filters, users=True)
    return _listed(found, found.cohorts())


def warning_cards(events: DataFrame, filters: EventFilters | None = None, cohorts: DataFrame | None = None) -> DataFrame:
    """The cards of the detectors by day and campaign, from one pass made when this is called, and of a given cohort table."""
    return _listed(Detectors(events, filters), cohorts)


def _listed(found: Detectors, cohorts: DataFrame | None) -> DataFrame:
    """Rows ``(severity, title, message)``, by detector and then by size of z.

    One ``info`` row stands in where no detector finds anything.
    """
    z = signed(F.col("z_score"), 2)
    by_size = F.when(F.abs("z_score") >= HIGH_Z, "high").otherwise("medium")
    medium = F.lit("medium")
    day, direction = F.col("date").cast("string"), F.col("direction")
    parts = [
        _cards(found.revenue(), "revenue", by_size, [direction, day], [fixed(F.col("revenue"), 2), z], day),
        _cards(
            found.traffic(), "traffic", by_size, [direction, day],
            [F.col("event_count").cast("string"), z], day,
        ),
        _cards(
            found.campaigns(), "campaign", medium, [F.col("campaign"), F.col("year_month")],
            [signed(F.col("revenue_growth_pct"), 1), z], F.concat_ws("|", "campaign", "year_month"),
        ),
    ]
    if cohorts is not None:
        month = F.col("cohort_month")
        parts.append(
            _cards(retention_anomalies(cohorts), "retention", medium, [month], [fixed(F.col("Day 30"), 1), z], month)
        )
    cards = reduce(DataFrame.unionByName, parts)
    title, message = WARNING_TEXT["none"]
    nothing = cards.sparkSession.range(1).select(
        F.lit(len(WARNING_TEXT)).alias("kind"), F.lit(0.0).alias("size"), F.lit("").alias("key"),
        F.lit("info").alias("severity"), F.lit(title).alias("title"), F.lit(message).alias("message"),
    )
    # Only found rows and that one are in the window; each detector is in the plan once.
    both = cards.unionByName(nothing).withColumn("cards", F.count(F.lit(1)).over(Window.partitionBy()))
    listed = both.where((F.col("severity") != "info") | (F.col("cards") == 1)).orderBy("kind", F.desc("size"), "key")
    return listed.select("severity", "title", "message")


def shown_cards(cards: DataFrame, n: int = CARDS_SHOWN) -> DataFrame:
    return cards.limit(n)
