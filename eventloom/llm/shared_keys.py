"""Links between sets that share most of their elements, found by keys that every such pair has in common.

The elements of all sets are sorted in one order. If a set lacks at most m of
another's elements and the other way round, the first m + 1 elements of both
have one in common, so those are join keys, and no similar pair is missed.
Any order will do; elements known to be frequent come last, so that few sets share a key.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.llm.components import connected_components
from eventloom.session import durable, passing_folder, written

# Frequent elements are looked for in one of so many documents; they only decide the order.
SAMPLE_PART = 16
FREQUENT_ROWS, FREQUENT_LISTED = 2, 100_000
BROADCAST_ROWS = 200_000  # rows of connected groups that are sent to all tasks if counted to be no more

# Keys left to compare in full are taken in so many parts at most, one for so many rows, so that only one part of them is shuffled at a time.
PARTS, PART_ROWS = 16, 1_000_000

# A key, its row's n and its rank travel in one number; an n or rank that fills its bits is unknown. An unknown n rules nothing out; a rank is unknown only where n or its place is.
SMALL_BITS = 10
UNKNOWN = (1 << SMALL_BITS) - 1


def sampled(ident: Column) -> Column:
    return F.pmod(F.xxhash64(ident), F.lit(SAMPLE_PART)) == 0


def frequent(elements: DataFrame) -> list[int]:
    """The most frequent values of the only column, a bounded list."""
    (name,) = elements.columns
    counted = elements.groupBy(name).count().where(F.col("count") >= FREQUENT_ROWS)
    return [r[0] for r in counted.orderBy(F.desc("count"), name).limit(FREQUENT_LISTED).collect()]


def links_by_keys(
    keyed: DataFrame,
    may: Callable[..., Column],
    verified: Callable[[DataFrame], DataFrame],
    marks: Callable[[DataFrame], DataFrame] | None = None,
    alike: Callable[[str, str], Column] | None = None,
) -> DataFrame:
    """``(a, b)`` links that connect all similar rows of ``keyed(key, a, n, rank)``.

    ``rank`` is a small number of the key in its row, as its rank or place. ``may(n, rank, other_n, other_rank)``
    is false only where two rows cannot be similar by that key, and looks at ranks only for how far they are apart;
    it is not asked if n is unknown. ``verified`` gives of pairs ``(a, b)`` those that are similar.
    First each row is compared with the smallest of each of its keys, and with one that the key's hash picks, so that
    rows of a dense group meet many others. What that leaves apart
    is compared with all rows of the key that are not yet connected to it, at the first of several keys that two rows
    have in common one after the other. ``marks`` gives for rows ``(a)`` those with further columns
    from which ``alike(own, other)``, given the prefixes of their names, tells cheaply that two rows
    cannot be similar; such pairs are not written down.
    """

    def small(name: str) -> Column:
        return F.least(F.col(name).cast("long"), F.lit(UNKNOWN))

    def possible(n: Column, rank: Column, other_n: Column, other_rank: Column) -> Column:
        return (F.greatest(n, other_n) == UNKNOWN) | may(n, rank, other_n, other_rank)

    # Most keys occur once, so that their rows are what is shuffled most: two numbers each.
    packed = F.shiftleft(F.col("key"), 2 * SMALL_BITS).bitwiseOR(F.shiftleft(small("n"), SMALL_BITS)).bitwiseOR(small("rank"))
    key = F.shiftrightunsigned("packed", 2 * SMALL_BITS)
    low = F.col("packed").bitwiseAND(F.lit(UNKNOWN))
    dealt = keyed.select(packed.alias("packed"), "a").repartition(key)
    rows = dealt.select(key.alias("key"), "a", F.shiftrightunsigned("packed", SMALL_BITS).bitwiseAND(F.lit(UNKNOWN)).alias("n"), low.alias("rank"))
    same = Window.partitionBy("key")
    beside = same.orderBy(F.xxhash64("a", "key"))  # another order for each key
    shared = rows.select("*", F.lag(F.struct("a", "n", "rank")).over(beside).alias("before"))
    shared = shared.select("*", F.count("*").over(same).alias("rows"), F.min(F.struct("a", "n", "rank")).over(same).alias("least"))

    def near(other: str) -> Column:
        far = (F.col("a") == F.col(f"{other}.a")) | ~possible(F.col("n"), F.col("rank"), F.col(f"{other}.n"), F.col(f"{other}.rank"))
        return F.when(~far, F.col(f"{other}.a"))

    # Where two rows share a key, that pair is all there is to compare.
    several = F.col("rows") > 2
    others = F.array_compact(F.array(near("least"), F.when(several, near("before")))).alias("others")
    shared = shared.select("key", "a", F.col("n").cast("short"), F.col("rank").cast("short"), several.alias("several"), F.col("least.a").alias("least"), others)
    with passing_folder(keyed.sparkSession, "shared-keys") as folder:
        shared = written(shared.where("several or size(others) > 0"), folder)
        first = shared.select("a", F.explode("others").alias("b"))
        first = durable(first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        links = durable(verified(first))

        groups = durable(connected_components(links).withColumnRenamed("node", "a"))
        groups = F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups
        left = shared.where("a <> least and several")
        parts = min(PARTS, 1 + left.count() // PART_ROWS)
        marked = written(marks(left.select("a").distinct()), folder) if marks is not None else None

        def pairs_of(part: int, scratch: str) -> DataFrame:
            placed = left.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part).join(groups, "a", "left")
            placed = placed.select("key", "a", "n", "rank", F.coalesce("component", "a").alias("group"))
            mixed = placed.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("key")
            placed = placed.join(mixed, "key")
            # The key before in the same row and how far it is off, in one number. Where two rows have the same, they also meet at that key.
            last = F.lag(F.struct("key", "rank")).over(Window.partitionBy("a").orderBy("rank", "key"))
            off = F.shiftleft(last["key"], SMALL_BITS).bitwiseOR((F.col("rank") - last["rank"]).cast("long"))
            placed = placed.select("*", F.when(F.col("rank") < UNKNOWN, off).alias("last"))
            placed = written(placed.join(marked, "a") if marks is not None else placed, scratch)
            columns = [c for c in placed.columns if c != "key"]
            # Both sides of the join are the same shuffle; names differ only above it.
            pairs = placed.alias("own").join(placed.alias("other"), F.col("own.key") == F.col("other.key"))
            pairs = pairs.select(*[F.col(f"own.{c}").alias(c) for c in columns], *[F.col(f"other.{c}").alias(f"other_{c}") for c in columns])
            # In one condition, what is cheap and rules out most first.
            asked = (F.col("group") < F.col("other_group")) & possible(F.col("n"), F.col("rank"), F.col("other_n"), F.col("other_rank"))
            asked = asked & (F.col("last").isNull() | ~F.col("last").eqNullSafe(F.col("other_last")))
            pairs = pairs.where(asked & alike("", "other_") if marks is not None else asked)
            pairs = pairs.select(F.greatest("a", "other_a").alias("a"), F.least("a", "other_a").alias("b")).distinct()
            return pairs.join(first, ["a", "b"], "left_anti")

        found = []
        for part in range(parts):
            with passing_folder(keyed.sparkSession, "key-part") as scratch:
                found.append(durable(pairs_of(part, scratch)))
        rest = durable(reduce(DataFrame.unionByName, found).distinct()) if parts > 1 else found[0]
    if rest.isEmpty():
        return links
    return links.unionByName(verified(rest))
