"""Recency, frequency and monetary segments.

A score says in which fifth of all users a user's rank falls. Ranking every
user needs a total order, but the scores need only the four users at the fifth
boundaries. Users are range-partitioned by measure, value and id, the boundary
users are found from the partition sizes, and every user is then compared with
them where they are. Equal values are told apart by user id, so a value shared
by a large part of the users is split over many partitions like any other.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.filters import EventFilters
from eventloom.functions.numbers import half_even, ratio
from eventloom.operators.retention import user_level_aggregate
from eventloom.session import durable
from eventloom.wording import SEGMENT_ADVICE

MEASURES = ("recency_days", "frequency", "monetary")
FIFTHS = 5
ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def fifth_boundaries(users: DataFrame) -> DataFrame:
    """Rows ``(measure, fifth, value, user_id)``: the last user of fifths 1 to 4.

    Rank r (from 0) of n users is in fifth k or lower where 5r <= k(n-1).
    """
    long = users.select("user_id", *[F.col(m).cast("decimal(38,2)").alias(m) for m in MEASURES]).unpivot(
        ["user_id"], list(MEASURES), "measure", "value"
    )
    order = ("measure", "value", "user_id")
    placed = durable(
        long.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    )
    part = F.shiftright("place", ROW_BITS)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))  # one row per partition
    upto = F.sum("rows").over(Window.orderBy("part"))
    parts = sizes.select(
        "part", (upto - F.col("rows")).alias("start"), upto.alias("end"), F.sum("rows").over(Window.partitionBy()).alias("all")
    )

    # Measures follow each other in the order of their names, n rows each.
    n = F.floor(F.col("all") / len(MEASURES))
    ranks = F.array(
        *[
            F.struct(
                F.lit(name).alias("measure"),
                F.lit(k).alias("fifth"),
                (n * block + F.floor((n - 1) * k / FIFTHS)).alias("rank"),
            )
            for block, name in enumerate(sorted(MEASURES))
            for k in range(1, FIFTHS)
        ]
    )
    wanted = (
        parts.select("part", "start", "end", F.explode(ranks).alias("at"))
        .where((F.col("at.rank") >= F.col("start")) & (F.col("at.rank") < F.col("end")))
        .select(
            "at.measure", "at.fifth", (F.shiftleft("part", ROW_BITS) + F.col("at.rank") - F.col("start")).alias("place")
        )
    )  # twelve rows
    return placed.drop("measure").join(F.broadcast(wanted), "place").select("measure", "fifth", "value", "user_id")


def _score(measure: str, bounds: Column) -> Column:
    """1 plus the number of boundary users this user comes after; 3 for a single user."""
    mine = F.struct(F.col(measure).cast("decimal(38,2)").alias("value"), F.col("user_id"))
    above = F.lit(1)
    for k in range(1, FIFTHS):
        above = above + F.when(mine > bounds[f"{measure}_{k}"], 1).otherwise(0)
    return F.when(bounds["users"] == 1, 3).otherwise(above)


def segment_name(r: Column, f: Column, m: Column) -> Column:
    value = (f + m) / 2
    return (
        F.when((r >= 4) & (value >= 4), "Champions")
        .when((r >= 3) & (value >= 3), "Loyal Customers")
        .when((r >= 3) & (value >= 2), "Potential Loyalists")
        .when((r == 2) & (value >= 2), "Need Attention")
        .when((r <= 2) & (value >= 2), "At Risk")
        .otherwise("Lost Customers")
    )


def rfm_table(
    events: DataFrame, filters: EventFilters | None = None, snapshot_date: date | None = None
) -> DataFrame:
    """Scores and segment per user; recency counts from the last date seen, or a given one."""
    seen = durable(user_level_aggregate(events, filters))  # the only pass over the events
    anchor = F.lit(snapshot_date) if snapshot_date else seen.agg(F.max("last_event_date")).scalar()
    users = seen.select("user_id", F.datediff(anchor, "last_event_date").alias("recency_days"), "frequency", "monetary")
    cells = fifth_boundaries(users).groupBy().agg(
        *[
            F.max(F.when((F.col("measure") == m) & (F.col("fifth") == k), F.struct("value", "user_id"))).alias(f"{m}_{k}")
            for m in MEASURES
            for k in range(1, FIFTHS)
        ]
    )
    count = users.agg(F.count(F.lit(1))).scalar()
    bounds = cells.select("*", count.alias("users")).select(F.struct("*")).scalar()
    scored = users.select("*", bounds.alias("bounds")).select(
        "user_id",
        *MEASURES,
        (6 - _score("recency_days", F.col("bounds"))).alias("R"),
        _score("frequency", F.col("bounds")).alias("F"),
        _score("monetary", F.col("bounds")).alias("M"),
    )
    return scored.withColumn("rfm_segment", segment_name(F.col("R"), F.col("F"), F.col("M")))


def rfm_segment_summary(table: DataFrame) -> DataFrame:
    """Size, means and advice per segment, largest revenue first."""
    advice = F.lit(None).cast("string")
    for name, text in SEGMENT_ADVICE.items():
        advice = F.when(F.col("rfm_segment") == name, text).otherwise(advice)
    segments = table.groupBy("rfm_segment").agg(
        F.count("user_id").alias("users"),
        half_even(F.avg("recency_days"), 1).alias("avg_recency_days"),
        half_even(F.avg("frequency"), 1).alias("avg_frequency"),
        F.sum(F.col("monetary").cast("decimal(28,2)")).cast("double").alias("total_monetary"),
        F.count(F.lit(1)).alias("rows"),
    )
    everyone = F.sum("rows").over(Window.partitionBy())  # six rows
    return segments.select(
        "rfm_segment",
        "users",
        "avg_recency_days",
        "avg_frequency",
        "total_monetary",
        half_even(ratio(F.col("users"), everyone) * 100, 1).alias("pct_of_total"),
        advice.alias("recommendation"),
    ).orderBy(F.desc("total_monetary"))
