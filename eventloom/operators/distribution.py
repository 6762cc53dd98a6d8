"""Distribution of session durations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.measures import one_row
from eventloom.functions.numbers import ratio
from eventloom.functions.quantiles import histogram

BINS = 40
GRID_POINTS = 200
BANDWIDTH_FACTOR = 1.06


def duration_histogram(events: DataFrame, bins: int = BINS) -> DataFrame:
    """Equal-width bins from minimum to maximum, empty ones included.

    A constant column gets one unit of width around it.
    """
    counts = histogram(events, "session_duration").withColumn("value", F.col("value").cast("double"))
    ends = counts.agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("rows").alias("rows"))
    flat = F.col("low") == F.col("high")
    frame = ends.select(
        F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
        F.when(flat, 1.0).otherwise(F.col("high") - F.col("low")).alias("span"),
        "rows",
    )
    spot = F.floor((F.col("value") - F.col("frame.low")) * bins / F.col("frame.span"))
    binned = (
        counts.select("*", one_row(frame).alias("frame"))
        .groupBy(F.least(spot, F.lit(bins - 1)).alias("bin"))
        .agg(F.sum("rows").alias("events"))
    )
    listed = frame.where(F.col("rows").isNotNull()).select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = F.col("span") / bins
    events_in_bin = F.coalesce("events", F.lit(0))
    return (
        listed.join(binned, "bin", "left")
        .select(
            "bin",
            (F.col("low") + F.col("bin") * width).alias("lower"),
            (F.col("low") + (F.col("bin") + 1) * width).alias("upper"),
            events_in_bin.alias("events"),
            ratio(events_in_bin, F.col("rows") * width).alias("density"),
        )
        .orderBy("bin")
    )


def duration_density(events: DataFrame, points: int = GRID_POINTS) -> DataFrame:
    """Gaussian kernel density on an even grid; zero for a constant or tiny sample.

    Without events the grid runs from 0 to 1.

    Equal durations are counted first, so the work grows with the number of
    distinct durations and not with the events.
    """
    counts = histogram(events, "session_duration").withColumn("value", F.col("value").cast("double"))
    n = F.sum("rows")
    mean = F.sum(F.col("value") * F.col("rows")) / n
    stats = counts.agg(n.alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), mean.alias("mean"))
    spread = counts.select("*", one_row(stats).alias("s")).agg(
        F.sum(F.col("rows") * F.pow(F.col("value") - F.col("s.mean"), F.lit(2.0))).alias("squares")
    )
    deviation = F.sqrt(ratio(F.col("squares"), F.col("n") - 1))
    frame = stats.select("n", "low", "high", spread.scalar().alias("squares")).select(
        "n", F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce("high", F.lit(1.0)).alias("high"),
        (BANDWIDTH_FACTOR * deviation * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("width"),
    )
    step = (F.col("frame.high") - F.col("frame.low")) / (points - 1)
    # One task adds up the kernels of its durations before anything is shuffled.
    spread_out = counts.select(
        "value", "rows", one_row(frame).alias("frame"),
        F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"),
    ).select("*", (F.col("frame.low") + F.col("point") * step).alias("x"))
    grid = frame.select(
        F.struct("*").alias("frame"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    ).select("point", (F.col("frame.low") + F.col("point") * step).alias("x"))
    kernel = F.exp(-0.5 * F.pow(ratio(F.col("x") - F.col("value"), F.col("frame.width")), F.lit(2.0)))
    scale = F.first("frame.n") * F.first("frame.width") * math.sqrt(2 * math.pi)
    found = spread_out.groupBy("point").agg(ratio(F.sum(F.col("rows") * kernel), scale).alias("density"))
    return (
        grid.join(found, "point", "left")
        .select("point", "x", F.coalesce("density", F.lit(0.0)).alias("density"))
        .orderBy("point")
    )
