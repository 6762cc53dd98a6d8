"""Mixture-controlled packing by deficit round-robin over source queues.

Every window of tokens takes from each source its target share. What a share's
fraction leaves over is the queue's deficit, paid in a later window. Deficits
after any window follow from the targets alone (``Mixture``), so windows can be
filled by many tasks at once, each starting with the deficits that the windows
before it have left.

1. Texts become ids once; each task also adds up the tokens of its sources.
2. Those sums, a row for each task and source, give the place of every document in its source's queue.
3. Each document is cut where the windows cut its queue. Ids do not move between tasks.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.batches import short_batches, text_rows
from eventloom.llm.bpe import loader
from eventloom.session import fresh_path


@dataclass
class Mixture:
    """The order in which queues of known sizes give tokens, by weight, until all are empty.

    Queues are numbered; ``sizes`` and ``weights`` are whole numbers. The active
    queues are the leaves of a balanced tree. Of x tokens that a node gives, its
    left half gives ``floor(x * left weight / weight)`` and its right half the
    rest. So at any time a queue is within a few tokens (the depth of the tree)
    of its share, never takes back a token, and the turn of each token can be
    told from its place. When a queue runs empty, a new phase begins without it.
    """

    sizes: list[int]
    weights: list[int]
    starts: list[int] = field(default_factory=list)  # tokens given by all queues when a phase begins
    given: list[list[int]] = field(default_factory=list)  # by the first k queues then
    shares: list[list[int]] = field(default_factory=list)  # weights of the first k queues in the phase

    def __post_init__(self) -> None:
        left, t = list(self.sizes), 0
        while any(left):
            active = [w if n else 0 for w, n in zip(self.weights, left, strict=True)]
            if not any(active):
                active = [1 if n else 0 for n in left]
            shares = list(accumulate(active, initial=0))
            room = min(_turn(shares, k, n) for k, n in enumerate(left) if active[k])
            done = [n - rest for n, rest in zip(self.sizes, left, strict=True)]
            self.starts.append(t)
            self.given.append(list(accumulate(done, initial=0)))
            self.shares.append(shares)
            ends = [_before(shares, k, room) for k in range(len(left) + 1)]
            left = [n - (ends[k + 1] - ends[k]) for k, n in enumerate(left)]
            t += room
        self.total = t

    def slot(self, queue: int, t: int) -> tuple[int, int]:
        """Tokens that the queues before this one, and this queue, have given of the first t."""
        p = bisect_right(self.starts, t) - 1
        shares, given = self.shares[p], self.given[p]
        low, high, ahead, x = 0, len(shares) - 1, given[queue], t - self.starts[p]
        while high - low > 1:
            middle = (low + high) // 2
            whole = shares[high] - shares[low]
            left = x * (shares[middle] - shares[low]) // whole if whole else 0
            if queue < middle:
                high, x = middle, left
            else:
                low, x, ahead = middle, x - left, ahead + left
        return ahead, given[queue + 1] - given[queue] + x

    def turn(self, queue: int, place: int) -> int:
        """Which token of all the token at ``place`` of a queue is."""
        p = bisect_right(range(len(self.starts)), place, key=lambda p: self.given[p][queue + 1] - self.given[p][queue]) - 1
        own = self.given[p][queue + 1] - self.given[p][queue]
        return self.starts[p] + _turn(self.shares[p], queue, place - own)


def _before(shares: list[int], queue: int, x: int) -> int:
    """Of x tokens of one phase, those of the queues before this one."""
    low, high, ahead = 0, len(shares) - 1, 0
    while queue > low:
        if queue >= high:
            return ahead + x
        middle = (low + high) // 2
        whole = shares[high] - shares[low]
        left = x * (shares[middle] - shares[low]) // whole if whole else 0
        if queue <= middle:
            high, x = middle, left
        else:
            low, x, ahead = middle, x - left, ahead + left
    return ahead


def _turn(shares: list[int], queue: int, place: int) -> int:
    """The index, among the tokens of one phase, of an active queue's token."""
    low, high, path = 0, len(shares) - 1, []
    while high - low > 1:
        middle = (low + high) // 2
        path.append((low, middle, high))
        low, high = (low, middle) if queue < middle else (middle, high)
    for low, middle, high in reversed(path):
        whole, left = shares[high] - shares[low], shares[middle] - shares[low]
        place = -((place + 1) * whole // -left) - 1 if queue < middle else place * whole // (whole - left)
    return place


def cut(mixture: Mixture, queue: int, place: int, tokens: int, size: int) -> list[tuple[int, int, int, int]]:
    """``(start, length, sequence, offset)`` of the pieces of a document at ``place`` of its queue."""
    pieces, done, sequence, edge = [], 0, -2, (0, 0)
    while done < tokens:
        at = place + done
        following = sequence + 1
        if following < 0 or mixture.slot(queue, min((following + 1) * size, mixture.total))[1] <= at:
            following = mixture.turn(queue, at) // size
        others, own = edge if following == sequence + 1 else mixture.slot(queue, following * size)
        edge = ahead, end = mixture.slot(queue, min((following + 1) * size, mixture.total))
        sequence = following
        length = min(tokens - done, end - at)
        pieces.append((done, length, sequence, ahead - others + at - own))
        done += length
    return pieces


def _tokens(docs: DataFrame, path: str, end_id: int, id_column: str, text_column: str, source_column: str) -> DataFrame:
    """``(part, id, queue, tokens, place, ids)``: place is among the same queue's tokens of one task's rows."""
    load = loader(docs.sparkSession, path)
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, part, filled = load(), TaskContext.get().partitionId(), {}
        for batch in batches:
            queues = batch.column("queue").to_pylist()
            ids = [x + end for x in vocabulary.encode(batch.column("text").to_pylist())]
            places = []
            for queue, x in zip(queues, ids, strict=True):
                places.append(filled.get(queue, 0))
                filled[queue] = places[-1] + len(x) // 4
            columns = [
                pa.array([part] * len(ids), pa.int32()), batch.column("id"), batch.column("queue"),
                pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(places, pa.int64()), pa.array(ids, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["part", "id", "queue", "tokens", "place", "ids"])

    source = F.col(f"`{source_column}`").cast("string")
    queue = F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("queue")
    rows = text_rows(docs, id_column, text_column, queue)
    return rows.mapInArrow(run, "part int, id long, queue string, tokens long, place long, ids binary")


def pack(
    docs: DataFrame,
    path: str,
    end_id: int = 2,
    size: int = 4096,
    weights: dict[str | None, int] | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """``(id, start, length, ids, tokens, sequence, offset)``: pieces of documents in windows of ``size`` tokens.

    Every document is its ids and then ``end_id``; each id is in one piece. All
    windows are full but the last. ``weights`` are the target proportions of
    sources as whole numbers, 1 for a source not named; without them the targets
    are the proportions of the corpus, so that all queues end together. The
    result is the same for the same split of the input into tasks.

    Null and empty texts are the end id alone. Rows with a null source have a
    queue of their own, rows without an id are packed like others, repeated
    rows are packed again, other columns are ignored, and an empty table gives
    no rows. The driver sees one number for each source.
    """
    spark = docs.sparkSession
    short_batches(spark)
    folder = fresh_path(spark, "packing")
    coded = _tokens(docs, path, end_id, id_column, text_column, source_column)
    coded.write.option("compression", "zstd").parquet(f"{folder}/tokens")
    coded = spark.read.schema(coded.schema).parquet(f"{folder}/tokens")

    sums = coded.groupBy("part", "queue").agg(F.sum("tokens").alias("tokens"))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", "queue", "tokens", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("first"))
    offsets.write.parquet(f"{folder}/offsets")  # of a known size, so that it is sent along only where it is small
    offsets = spark.read.schema(offsets.schema).parquet(f"{folder}/offsets")

    totals = sorted((r["queue"], r["n"]) for r in offsets.groupBy("queue").agg(F.sum("tokens").alias("n")).collect())
    targets = {"" if k is None else f"={k}": w for k, w in (weights or {}).items()}
    mixture = Mixture([n for _, n in totals], [targets.get(q, 1) if weights else n for q, n in totals])
    number = {q: k for k, (q, _) in enumerate(totals)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "start", "length", "ids", "tokens", "sequence", "offset"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("id", "queue", "tokens", "place", "first", "ids")]
            rows: list[tuple] = []
            for ident, queue, tokens, place, first, ids in zip(*columns, strict=True):
                for start, length, sequence, offset in cut(mixture, number[queue], first + place, tokens, size):
                    rows.append((ident, start, length, ids[4 * start : 4 * (start + length)], tokens, sequence, offset))
            for at in range(0, len(rows), 4096):
                part = zip(*rows[at : at + 4096], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(part, kinds, strict=True)], names)

    placed = coded.join(offsets.select("part", "queue", "first"), ["part", "queue"])
    placed = placed.select("id", "queue", "tokens", "place", "first", "ids")
    return placed.mapInArrow(run, "id long, start long, length long, ids binary, tokens long, sequence long, offset long")
