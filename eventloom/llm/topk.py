"""Exact top-k search: tiles of queries times tiles of candidates, and a tree of merges.

Queries and candidates are dealt into blocks of bounded size. Each pair of blocks is one cell of a grid, in
which matrix products run tile by tile and keep k candidates a query. Cells that share queries are merged by
groups, and the groups again, until one list a query is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.batches import short_batches
from eventloom.session import durable

QUERY_ROWS, SHARD_ROWS = 8192, 16384  # rows of a block; a task holds one of each
TILE_QUERIES, TILE_ROWS = 512, 2048  # rows of one matrix product
FAN_IN = 16
LONG = 2**63 - 1


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    flat = column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), size)


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; what no long can hold becomes the nearest long."""
    if not queries.size or not rows.size:
        return np.zeros((len(queries), len(rows)), np.int64)
    largest = int(np.abs(queries.astype(object)).max()) if queries.dtype == object else float(np.abs(queries.astype(np.float64)).max())
    if largest * float(np.abs(rows.astype(np.float64)).max()) * queries.shape[1] < 2**53:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    exact = queries.astype(object) @ rows.astype(object).T
    return np.clip(exact, -LONG - 1, LONG).astype(np.int64)


def _select(scores: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Mask of the k highest allowed scores in each row; of equal scores the first columns."""
    if scores.shape[1] <= k:
        return allowed
    low = np.where(allowed, scores, np.iinfo(np.int64).min)
    bar = np.partition(low, scores.shape[1] - k, axis=1)[:, -k][:, None]
    above = allowed & (low > bar)
    level = allowed & (low == bar)
    return above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)))


def _cell(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The best k rows of one block for each query of another."""
    names = ["query", "part", "score", "id"]
    kinds = [pa.int64()] * 4
    found: list[np.ndarray] = []
    if queries.num_rows and rows.num_rows:
        size = queries.column("dim")[0].as_py()
        part = rows.column("shard")[0].as_py()
        rows = rows.sort_by("id")
        ids, matrix = rows.column("id").to_numpy(), _matrix(rows.column("vector"), size)
        query_ids, wanted = queries.column("id").to_numpy(), _matrix(queries.column("vector"), size)
        for q in range(0, len(query_ids), TILE_QUERIES):
            own = query_ids[q : q + TILE_QUERIES]
            best = [np.zeros(0, np.int64)] * 3
            for r in range(0, len(ids), TILE_ROWS):
                these = ids[r : r + TILE_ROWS]
                scores = _products(wanted[q : q + TILE_QUERIES], matrix[r : r + TILE_ROWS])
                at, column = np.nonzero(_select(scores, own[:, None] != these[None, :], k))
                best = _merge([np.r_[a, b] for a, b in zip(best, (at, scores[at, column], these[column]), strict=True)], k)
            found.append(np.stack([own[best[0]], np.full(len(best[0]), part), best[1], best[2]]))
    columns = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def _merge(lists: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of (query, score, id) the first k of each query, by falling score and then id."""
    query, score, ident = lists
    order = np.lexsort((ident, -score.astype(object) if score.size and score.min() == -LONG - 1 else -score, query))
    query = query[order]
    place = np.arange(len(query)) - np.searchsorted(query, query, side="left")
    order = order[place < k]
    return [x[order] for x in lists]


def _merged(lists: DataFrame, k: int, *keys: Column) -> DataFrame:
    """One list of at most k ``(score, id)`` for each key, from at most a few such lists."""
    entry = F.struct((-F.col("score").cast("decimal(20,0)")).alias("down"), "id", "score")
    best = F.slice(F.sort_array(F.collect_list(entry)), 1, k)
    return lists.groupBy(*keys).agg(best.alias("best"))


def exact_top_k(queries: DataFrame, rows: DataFrame, k: int = 5, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``(query_id, rank, id, score)``: for each query the k rows with the highest inner products.

    Components become ``floor(scale * x)``; scores are exact whole numbers (beyond
    the range of a long, the nearest long). Equal scores rank by smaller id; a
    row with the query's own id is no candidate. Null vectors, those with a null
    or non-finite component and rows without an id take no part. Vectors meet
    only vectors of their own length. Repeated rows count once, and other
    columns are ignored. Fewer than k candidates give a shorter list, none give no rows.
    """
    spark = rows.sparkSession
    short_batches(spark)

    def whole(table: DataFrame) -> DataFrame:
        vector = F.col(f"`{vector_column}`")
        chosen = table.where(F.col(f"`{id_column}`").isNotNull() & usable(vector))
        ints = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
        # Each row once: spread by content, so that no id or vector can fill one block.
        return chosen.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.size(vector).alias("dim"), ints.alias("vector")).distinct()

    asked, known = durable(whole(queries)), durable(whole(rows))
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    shards = max(1, -(-known.count() // SHARD_ROWS))
    spread = F.xxhash64("id", "vector")
    asked = asked.withColumn("block", F.pmod(spread, F.lit(blocks))).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    known = known.withColumn("shard", F.pmod(spread, F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    cells = ("dim", "block", "shard")
    lists = (
        asked.groupBy(*cells)
        .cogroup(known.groupBy(*cells))
        .applyInArrow(lambda a, b: _cell(a, b, k), "query long, part long, score long, id long")
    )
    while shards > FAN_IN:
        shards = -(-shards // FAN_IN)
        best = _merged(lists, k, F.col("query"), F.floor(F.col("part") / FAN_IN).alias("part"))
        lists = best.select("query", "part", F.explode("best").alias("b")).select("query", "part", "b.score", "b.id")
    best = _merged(lists, k, F.col("query"))
    return best.select(F.col("query").alias("query_id"), F.posexplode("best").alias("place", "b")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("b.id").alias("id"), F.col("b.score").alias("score")
    )
