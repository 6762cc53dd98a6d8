"""Exact quantiles of a whole-number column."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOW_BITS = 16  # a 32-bit value has at most 65,536 high halves and as many low halves


def histogram(events: DataFrame, column: str) -> DataFrame:
    """Rows ``(value, rows)`` per distinct non-null value."""
    return (
        events.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def quantiles(events: DataFrame, column: str, wanted: Mapping[str, float]) -> DataFrame:
    """One row with one linearly interpolated quantile per name in ``wanted``.

    Meant for 32-bit whole numbers, with or without a fractional cap among
    them. Values are looked up by their high bits first, then by their low bits
    in the few blocks that hold a wanted rank. No window sees more than about
    65,536 rows, however many events or distinct values there are.
    """
    return quantiles_of(histogram(events, column), wanted)


def quantiles_of(counts: DataFrame, wanted: Mapping[str, float]) -> DataFrame:
    """The same from rows ``(value, rows)``, one for each distinct value."""
    block = F.shiftright(F.col("value").cast("bigint"), LOW_BITS)
    # The join below needs a block; asking for it here lets both uses share one shuffle.
    counts = counts.where(block.isNotNull())

    blocks = counts.groupBy(block.alias("block")).agg(F.sum("rows").alias("rows"))
    blocks = blocks.select(
        "block",
        F.sum("rows").over(Window.orderBy("block")).alias("upto"),
        "rows",
        F.sum("rows").over(Window.partitionBy()).alias("total"),
    )
    spots = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(q).alias("q")) for name, q in wanted.items()])
    ranks = (
        blocks.select("*", F.explode(spots).alias("spot"))
        .select("*", "spot.name", ((F.col("total") - 1) * F.col("spot.q")).alias("place"))
        .select(
            "block", "upto", "rows", "name", "place",
            F.explode(F.array(F.struct(F.lit("low").alias("side"), F.floor("place").alias("rank")),
                              F.struct(F.lit("high").alias("side"), F.ceil("place").alias("rank")))).alias("at"),
        )
        .where((F.col("at.rank") >= F.col("upto") - F.col("rows")) & (F.col("at.rank") < F.col("upto")))
        .select("block", "name", "place", "at.side", "at.rank", (F.col("upto") - F.col("rows")).alias("before"))
    )  # two rows per wanted quantile

    within = counts.select("value", "rows", block.alias("block")).join(
        F.broadcast(ranks.select("block", "before").distinct()), "block"
    )
    inside = Window.partitionBy("block").orderBy("value")
    within = within.withColumn("end", F.col("before") + F.sum("rows").over(inside))
    hits = within.join(F.broadcast(ranks.drop("before")), "block").where(
        (F.col("rank") >= F.col("end") - F.col("rows")) & (F.col("rank") < F.col("end"))
    )

    def pick(name: str, side: str):
        return F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col("value"))).cast("double")

    def interpolate(name: str):
        low, high = pick(name, "low"), pick(name, "high")
        place = F.max(F.when(F.col("name") == name, F.col("place")))
        return (low + (high - low) * (place - F.floor(place))).alias(name)

    return hits.agg(*[interpolate(name) for name in wanted])
