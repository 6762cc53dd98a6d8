"""Shards of nearly equal bytes by fixed virtual slots: DataFrame functions only.

Records are hashed into a fixed number of slots, thousands of them. Bytes and rows are added up by slot, and a map says which
shard holds each slot. The map is stored in versions: rebalancing adds a version that lists only the slots that move, so
that a record's slot never changes and most slots stay where they are. A slot that holds far more than its share (one id
with very many rows) is split into parts, which the map places one by one.

Only the sums by slot and the map, some thousands of numbers whatever the table, are handled by the driver.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.session import durable

SLOTS = 4096
ROW_BYTES = 16  # of a record besides its text
PARTS_OF_A_SHARE = 16  # a slot over a shard's share divided by this is split
MAP_SCHEMA = "version int, slot int, part int, parts int, shard int, bytes long, rows long"

Place = tuple[int, int]  # slot and part


def slot_of(ident: Column, text_crc32: Column, slots: int) -> Column:
    """The fixed slot of a record: by its id, or by its text where it has none."""
    return F.pmod(F.xxhash64(F.coalesce(ident.cast("string"), F.concat(F.lit("text "), text_crc32.cast("string")))), F.lit(slots)).cast("int")


def numbered_records(docs: DataFrame, id_column: str, text_column: str, slots: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """``(id, size, text_crc32, record, slot, row)``, written once so that ``row`` stays the same for all readers; ``record`` has the carried columns."""
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    size = (F.octet_length(text) + F.lit(ROW_BYTES).cast("long")).alias("size")
    record = [F.struct(*[F.col(f"`{c}`") for c in carried]).alias("record")] if carried else []
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), size, F.crc32(text).alias("text_crc32"), *record)
    rows = rows.withColumn("slot", slot_of(F.col("id"), F.col("text_crc32"), slots))
    return durable(rows.withColumn("row", F.monotonically_increasing_id()))


def _looked_up(numbers: list[int], place: Column, kind: str) -> Column:
    """``numbers[place]`` from one constant, parsed once for each task."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast(f"array<{kind}>")[place]


def _part(parts: dict[int, int], slots: int) -> Column:
    """The part of a record's slot: rows of split slots are dealt out by their number, all others are part 0."""
    if not parts:
        return F.lit(0)
    many = _looked_up([parts.get(s, 1) for s in range(slots)], F.col("slot"), "int")
    return F.pmod(F.xxhash64("row"), many).cast("int")


def place_sums(records: DataFrame, shards: int, slots: int) -> tuple[dict[int, int], dict[Place, tuple[int, int]]]:
    """How many parts split slots have, and bytes and rows of every place that holds records."""
    sums = {r.slot: (r.bytes, r.rows) for r in records.groupBy("slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}
    most = sum(b for b, _ in sums.values()) / (shards * PARTS_OF_A_SHARE)
    parts = {s: min(n, -int(-b // most)) for s, (b, n) in sums.items() if b > most and n > 1}
    placed = {(s, 0): v for s, v in sums.items() if s not in parts}
    if parts:
        split = records.where(F.col("slot").isin(list(parts))).groupBy("slot", _part(parts, slots).alias("part"))
        placed |= {(s, p): (0, 0) for s, n in parts.items() for p in range(n)}
        placed |= {(r.slot, r.part): (r.bytes, r.rows) for r in split.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}
    return parts, placed


def balanced(sizes: dict[Place, int], shards: int, now: dict[Place, int] | None = None) -> dict[Place, int]:
    """A shard for each place so that bytes are nearly equal; places stay where ``now`` has them as far as shares allow.

    Each shard keeps its places, large ones first, while they fit its share. The rest goes, large ones first, to the shard
    with least. Then places move or change sides with smaller ones wherever that brings two shards closer together.
    Where that gains less than a thousandth of a share, all stay as they are.
    """
    now = {p: s for p, s in (now or {}).items() if p in sizes and s < shards}
    share = sum(sizes.values()) / shards
    loads = [0] * shards
    chosen: dict[Place, int] = {}
    ordered = sorted(sizes, key=lambda p: (-sizes[p], p))
    for p in ordered:
        if p in now and loads[now[p]] + sizes[p] <= share:
            chosen[p] = now[p]
            loads[now[p]] += sizes[p]
    heap = [(load, s) for s, load in enumerate(loads)]
    heapq.heapify(heap)
    for p in ordered:
        if p not in chosen:
            load, s = heapq.heappop(heap)
            chosen[p] = s
            loads[s] = load + sizes[p]
            heapq.heappush(heap, (loads[s], s))
    held: dict[int, set[Place]] = defaultdict(set)
    for p, s in chosen.items():
        held[s].add(p)

    def give(low: int, high: int) -> bool:
        """Bring two shards closer by the move or exchange whose difference is nearest to half of theirs."""
        gap = loads[high] - loads[low]
        back = sorted((sizes[p], p) for p in held[low])
        best = None
        for p in held[high]:
            for size, other in [(0, None), *back]:
                moved = sizes[p] - size
                if 0 < moved < gap and (best is None or abs(2 * moved - gap) < best[0]):
                    best = abs(2 * moved - gap), p, other, moved
        if best is None:
            return False
        _, p, other, moved = best
        held[high].remove(p)
        held[low].add(p)
        if other is not None:
            held[low].remove(other)
            held[high].add(other)
        loads[high] -= moved
        loads[low] += moved
        return True

    # Some rounds are enough: each brings the fullest shard that can give and the emptiest one closer.
    for _ in range(4 * shards):
        by_load = sorted(range(shards), key=lambda s: loads[s])
        if loads[by_load[-1]] - loads[by_load[0]] <= share / 1000:
            break
        if not any(give(by_load[0], high) for high in reversed(by_load[1:])):
            break
    if len(now) == len(sizes):
        before = [0] * shards
        for p, s in now.items():
            before[s] += sizes[p]
        if max(before) - min(before) <= max(loads) - min(loads) + share / 1000:
            return now
    return {p: s for s, places in held.items() for p in places}


class SlotMap:
    """Versions of a slot-to-shard map, as a table below ``folder``; each version lists the places that it sets."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.path = spark, f"{folder}/slot-map"

    def versions(self) -> DataFrame:
        return self.spark.read.schema(MAP_SCHEMA).parquet(self.path)

    def at(self, version: int | None = None) -> dict[Place, int]:
        """The shard of each place, by the newest entry up to ``version``."""
        rows = self.versions()
        rows = rows if version is None else rows.where(F.col("version") <= version)
        newest = rows.groupBy("slot", "part").agg(F.max_by("shard", "version").alias("shard"))
        return {(r.slot, r.part): r.shard for r in newest.collect()}

    def newest(self) -> int | None:
        """The number of the newest version; None where none is stored yet."""
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            return None
        return self.versions().agg(F.max("version")).first()[0]

    def store(self, version: int, chosen: dict[Place, int], parts: dict[int, int], sums: dict[Place, tuple[int, int]]) -> None:
        """Append a version in one file; a version of no changes is stored as one row without a slot, so that it counts."""
        places = sorted(chosen)
        columns = {
            "slot": [s for s, _ in places],
            "part": [p for _, p in places],
            "parts": [parts.get(s, 1) for s, _ in places],
            "shard": [chosen[p] for p in places],
            "bytes": [sums.get(p, (0, 0))[0] for p in places],
            "rows": [sums.get(p, (0, 0))[1] for p in places],
        }
        kinds = {"bytes": "long", "rows": "long"}
        # One constant for each column: the rows are the places of a list.
        listed = [_looked_up(v, F.col("id").cast("int"), kinds.get(c, "int")).alias(c) if places else F.lit(None).cast(kinds.get(c, "int")).alias(c) for c, v in columns.items()]
        table = self.spark.range(max(1, len(places)), numPartitions=1).select(F.lit(version).alias("version"), *listed)
        table.write.mode("append").parquet(self.path)

    def rebalance(self, sums: dict[Place, tuple[int, int]], parts: dict[int, int], shards: int, slots: int = SLOTS) -> dict[Place, int]:
        """The map for these bytes: a first version with all slots dealt in turn, then one that lists what moves."""
        version = self.newest()
        if version is None:
            version = 0
            self.store(0, {(s, 0): s % shards for s in range(slots)}, {}, {})
        now = {p: s for p, s in self.at(version).items() if p[0] is not None}
        chosen = balanced({p: b for p, (b, _) in sums.items()}, shards, now)
        moved = {p: s for p, s in chosen.items() if now.get(p) != s}
        self.store(version + 1, moved, parts, sums)
        return {**now, **chosen}


def assign_shards(
    docs: DataFrame,
    slot_map: SlotMap,
    shards: int = 40,
    slots: int = SLOTS,
    id_column: str = "doc_id",
    text_column: str = "text",
    carried: tuple[str, ...] = (),
) -> DataFrame:
    """``(id, size, text_crc32, virtual_slot, part, shard, position)`` for every row, after rebalancing ``slot_map``.

    ``size`` is the text's UTF-8 bytes and ROW_BYTES. ``position`` counts a shard's rows from 0 without gaps, by place, id,
    checksum and size. The slot depends on the id alone, or for rows without an id on the text. Null texts count as
    empty. Repeated rows are records of their own; where they outgrow a slot, its parts spread them over shards. One record
    larger than a shard's share stays whole. With ``carried``, a struct ``record`` has these columns of the input; others are
    ignored. An empty table gives no rows.
    """
    records = numbered_records(docs, id_column, text_column, slots, carried)
    parts, sums = place_sums(records, shards, slots)
    chosen = slot_map.rebalance(sums, parts, shards, slots)
    # Places in order, with the shard of each, the rows of its shard before it, and the first place of each slot.
    order = sorted(sums) or [(0, 0)]
    first, shard, before, filled = [0] * slots, [], [], [0] * shards
    for i, place in enumerate(order):
        if place[1] == 0:
            first[place[0]] = i
        shard.append(chosen.get(place, 0))
        before.append(filled[shard[-1]])
        filled[shard[-1]] += sums.get(place, (0, 0))[1]
    part = _part(parts, slots)
    placed = records.select("*", part.alias("part"), (_looked_up(first, F.col("slot"), "int") + part).alias("place"))
    # A window holds one place: a slot's share of all records, or one part of a split slot.
    within = Window.partitionBy("place").orderBy("id", "text_crc32", "size", "row")
    position = F.row_number().over(within) - 1 + _looked_up(before, F.col("place"), "long")
    columns = ["id", "size", "text_crc32", F.col("slot").alias("virtual_slot"), "part", _looked_up(shard, F.col("place"), "int").alias("shard"), position.alias("position")]
    return placed.select(*columns, *(["record"] if carried else []))


def write_shards(docs: DataFrame, slot_map: SlotMap, path: str, shards: int = 40, slots: int = SLOTS, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Write all rows and columns of ``docs`` to one folder a shard, in files of whole places, ordered by position."""
    placed = assign_shards(docs, slot_map, shards, slots, id_column, text_column, tuple(docs.columns))
    placed.sortWithinPartitions("shard", "position").select("shard", "position", "record").write.partitionBy("shard").parquet(path)
