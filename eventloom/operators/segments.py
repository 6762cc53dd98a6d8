"""Summaries over many dimensions in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.measures import money, summarise
from eventloom.functions.numbers import ratio
from eventloom.schema import SEGMENT_DIMENSIONS


def segment_rows(events: DataFrame, dimensions: Sequence[str], *columns: str) -> DataFrame:
    """Each event once per dimension, as ``(dimension, segment)``; nulls left out."""
    named = events.select(*columns, *[F.col(name).cast("string").alias(name) for name in dimensions])
    rows = named.unpivot(list(columns), list(dimensions), "dimension", "segment")
    return rows.where(F.col("segment").isNotNull())


def segmentation(events: DataFrame, dimensions: Sequence[str] = SEGMENT_DIMENSIONS) -> DataFrame:
    """Users, events, revenue and mean session duration per value of each dimension.

    Events are first added up by user and all dimensions together, and only what
    is left is listed once per dimension. A user is then counted once per value
    by adding up again, so no list of users or values is ever held.
    """
    sums = {"events": "count(event_name)", "revenue": "sum(cast(revenue AS decimal(18,2)))",
            "duration": "sum(session_duration)", "timed": "count(session_duration)"}
    texts = [F.col(name).cast("string").alias(name) for name in dimensions]
    joint = events.groupBy("user_id", *texts).agg(*[F.expr(x).alias(name) for name, x in sums.items()])
    # The count of a user's rows by value needs the user under a name that no dimension has.
    listed = segment_rows(joint.withColumnRenamed("user_id", "_user"), dimensions, "_user", *sums)
    users = listed.groupBy("dimension", "segment", "_user").agg(*[F.sum(name).alias(name) for name in sums])
    return (
        users.groupBy("dimension", "segment")
        .agg(
            F.count("_user").alias("users"),
            F.sum("events").alias("events"),
            F.sum("revenue").cast("double").alias("revenue"),
            ratio(F.sum("duration").cast("double"), F.sum("timed")).alias("avg_session_duration"),
        )
        .orderBy("dimension", F.desc("revenue"), "segment")
    )


def segment_summary(events: DataFrame, dimension: str) -> DataFrame:
    """The same measures for one dimension, in its own column."""
    return (
        summarise(events.where(F.col(dimension).isNotNull()), dimension)
        .select(dimension, "users", F.col("named_events").alias("events"), "revenue", "avg_session_duration")
        .orderBy(F.desc("revenue"), dimension)
    )


def summary_table(events: DataFrame, dimension: str) -> DataFrame:
    """Revenue efficiency of one dimension, with its share of all revenue."""
    total = events.agg(F.sum(money()).cast("double")).scalar()
    table = summarise(events.where(F.col(dimension).isNotNull()), dimension)
    return (
        table.select(
            dimension,
            "users",
            F.coalesce("revenue", F.lit(0.0)).alias("revenue"),
            ratio(F.col("revenue"), F.col("users")).alias("arpu"),
            ratio(100.0 * F.col("payers"), F.col("users")).alias("conversion_rate_pct"),
            ratio(F.col("paid"), F.col("payments")).alias("avg_purchase_value"),
            ratio(100.0 * F.col("revenue"), total).alias("pct_share"),
        )
        .na.fill(0.0)
        .orderBy(F.desc("revenue"), dimension)
    )


def segment_totals(events: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Revenue and event count per value of each dimension."""
    return (
        segment_rows(events, dimensions, "revenue")
        .groupBy("dimension", "segment")
        .agg(F.sum(money()).cast("double").alias("revenue"), F.count(F.lit(1)).alias("events"))
    )


def leader(dimension: str, measure: str, keep: str = "true") -> Column:
    """Over segment totals: ``(low, segment)`` of the largest measure.

    ``low`` is the measure with its sign turned, so that of equal measures the
    first name wins.
    """
    return F.expr(f"min(struct(-{measure} AS low, segment)) FILTER (WHERE dimension = '{dimension}' AND {keep})")


def total_of(dimension: str, measure: str, keep: str = "true") -> Column:
    return F.expr(f"sum({measure}) FILTER (WHERE dimension = '{dimension}' AND {keep})")
