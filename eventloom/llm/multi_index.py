"""Embedding near-duplicates by an inverted multi-index.

Each half of a unit vector has its own codebook; a pair of codes is a cell of the
product grid. Every vector lies in one cell and looks for others in the cells
nearest to it, in the order of a multi-sequence traversal. How many cells it
visits follows from the target recall, measured on a sample for neighbours at
the threshold itself. Cosines verify all that meet in a cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from eventloom.llm.batches import short_batches
from eventloom.llm.components import connected_components
from eventloom.llm.topk import usable
from eventloom.session import durable

SAMPLE_ROWS = 4096  # rows, with the smallest hashes of their ids, that codebooks are fitted on
CELL_ROWS = 64  # aim for rows of a label in a cell
MOST_CODES = 256
TARGET_RECALL = 0.999
SIDE_ROWS = 2048  # vectors on each side of one task's comparison


@dataclass
class Grid:
    """Codebooks of both halves, and the number of cells that a vector visits."""

    first: np.ndarray
    second: np.ndarray
    visits: int = 1

    def cells(self, vectors: np.ndarray, visits: int) -> np.ndarray:
        """Numbers of the nearest cells of each unit vector, nearest first.

        The cell of the i-th and j-th nearest codes comes after all cells nearer in
        both halves, so only those with i * j up to ``visits`` need be ordered.
        """
        half = self.first.shape[1]
        a, b = _squared(vectors[:, :half], self.first), _squared(vectors[:, half:], self.second)
        near_a, near_b = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
        i, j = np.nonzero(np.outer(np.arange(1, a.shape[1] + 1), np.arange(1, b.shape[1] + 1)) <= visits)
        codes_a, codes_b = near_a[:, i], near_b[:, j]
        sums = np.take_along_axis(a, codes_a, 1) + np.take_along_axis(b, codes_b, 1)
        order = np.argsort(sums, axis=1, kind="stable")[:, :visits]
        return np.take_along_axis(codes_a * len(self.second) + codes_b, order, 1)


def _squared(points: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (points**2).sum(1)[:, None] - 2 * points @ codes.T + (codes**2).sum(1)[None, :]


def _codebook(points: np.ndarray, size: int) -> np.ndarray:
    """k-means from evenly spaced sample points; codes left empty stay where they are."""
    points = np.unique(points, axis=0)
    codes = points[np.linspace(0, len(points) - 1, min(size, len(points))).astype(int)]
    for _ in range(12):
        nearest = _squared(points, codes).argmin(1)
        sums, counts = np.zeros_like(codes), np.bincount(nearest, minlength=len(codes))
        np.add.at(sums, nearest, points)
        codes = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], codes)
    return codes


def fit_grid(sample: np.ndarray, codes: int, cosine: float, recall: float) -> Grid:
    """A grid for unit vectors, with the visits that find ``recall`` of neighbours at ``cosine``.

    For each sampled vector a neighbour is made at exactly that cosine in a random
    direction; how far down the traversal its cell comes is what has to be visited.
    """
    half = (sample.shape[1] + 1) // 2
    grid = Grid(_codebook(sample[:, :half], codes), _codebook(sample[:, half:], codes))
    every = len(grid.first) * len(grid.second)
    away = np.random.default_rng(0).normal(size=sample.shape)
    away -= (away * sample).sum(1)[:, None] * sample
    away /= np.maximum(np.linalg.norm(away, axis=1), 1e-300)[:, None]
    other = cosine * sample + np.sqrt(max(0.0, 1 - cosine**2)) * away
    homes = grid.cells(other, 1)
    places: list[np.ndarray] = []
    for at in range(0, len(sample), 256):
        order = grid.cells(sample[at : at + 256], every)
        places.append((order == homes[at : at + 256]).argmax(1))
    grid.visits = min(every, 1 + int(np.quantile(np.concatenate(places), recall, method="higher")))
    return grid


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1)[:, None]  # else squares of tiny components vanish
    return scaled / np.linalg.norm(scaled, axis=1)[:, None]


def _vectors(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _cell_links(own: pa.Table, homes: pa.Table, cosine: float) -> pa.Table:
    """For vectors that visit a cell: how many rows of the cell they link to, and links that connect both sides."""
    names, kinds = ["id", "n", "other"], [pa.int64()] * 3
    out = np.zeros((3, 0), np.int64)
    if own.num_rows and homes.num_rows:
        size = own.column("dim")[0].as_py()
        a, b = own.column("class").to_numpy(), homes.column("class").to_numpy()
        weight = homes.column("rows").to_numpy()
        linked = _unit(_vectors(own.column("vector"), size)) @ _unit(_vectors(homes.column("vector"), size)).T >= cosine
        linked &= a[:, None] != b[None, :]
        counts = linked @ weight
        rows, columns = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
        linked, none = linked[np.ix_(rows, columns)], np.iinfo(np.int64).max
        low_a, low_b = a[rows], b[columns]
        while len(rows):
            new_a = np.minimum(low_a, np.where(linked, low_b[None, :], none).min(1))
            new_b = np.minimum(low_b, np.where(linked, new_a[:, None], none).min(0))
            if (new_a == low_a).all() and (new_b == low_b).all():
                break
            low_a, low_b = new_a, new_b
        zeros = np.zeros(len(columns), np.int64)
        out = np.concatenate([np.stack([a[rows], counts[rows], low_a]), np.stack([b[columns], zeros, low_b])], axis=1)
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)


def near_duplicates(
    table: DataFrame,
    cosine: float = 0.93,
    recall: float = TARGET_RECALL,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """``(id, n_links, component, kept)`` for every row: links to other rows of the same label with at least that cosine.

    Equal vectors of a label are one row of the index, with their number, so copies
    link without being compared. ``component`` is the smallest id reachable, and
    that row is kept. No pair below ``cosine`` links; of those above, at least
    ``recall`` are met (measured at the threshold; nearer pairs are met more surely).

    Null and zero vectors, those with null or non-finite components, rows with a
    null label and vectors of different lengths link with nothing; a row without
    an id is returned with no links and a null component. Repeated rows are
    vectors of their own. Other columns are ignored; an empty table gives no rows.
    """
    spark = table.sparkSession
    short_batches(spark)
    vector = F.col(f"`{vector_column}`")
    rows = table.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{label_column}`").alias("label"), vector.alias("vector"))
    some = usable(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    part = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(some, F.lit(False))
    classes = durable(
        rows.where(part).groupBy("label", "vector").agg(F.min("id").alias("class"), F.count("*").alias("rows")).withColumn("dim", F.size("vector"))
    )
    groups = classes.agg(F.count("*"), F.approx_count_distinct("label")).first()
    codes = min(MOST_CODES, max(2, round((groups[0] / (CELL_ROWS * max(1, groups[1]))) ** 0.5)))
    sample = classes.orderBy(F.xxhash64("class"), "class").limit(SAMPLE_ROWS).select("vector").collect()
    by_size: dict[int, list] = {}
    for row in sample:
        by_size.setdefault(len(row[0]), []).append(row[0])
    grids = {size: fit_grid(_unit(np.array(found, np.float64)), codes, cosine, recall) for size, found in by_size.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            visited: list = [[0]] * len(sizes)  # a length that the sample lacks has one cell
            for size in np.unique(sizes):
                if size in grids:
                    at = np.flatnonzero(sizes == size)
                    found = grids[size].cells(_unit(_vectors(batch.column("vector").take(pa.array(at)), size)), grids[size].visits)
                    for i, cells in zip(at, found.tolist(), strict=True):
                        visited[i] = cells
            yield batch.append_column("cells", pa.array(visited, pa.list_(pa.int64())))

    placed = durable(classes.mapInArrow(place, StructType([*classes.schema, StructField("cells", ArrayType(LongType()))])))
    key = ("label", "dim", "cell")
    homes = placed.withColumn("cell", F.col("cells")[0])
    visits = placed.withColumn("cell", F.explode("cells"))
    sizes = homes.groupBy(*key).agg((F.floor(F.count("*") / F.lit(SIDE_ROWS)) + 1).alias("home_blocks"))
    sizes = sizes.join(visits.groupBy(*key).agg((F.floor(F.count("*") / F.lit(SIDE_ROWS)) + 1).alias("visit_blocks")), [*key])

    def blocks(side: DataFrame, own: str, other: str) -> DataFrame:
        """Rows of a large cell are dealt into blocks; each block meets each block of the other side."""
        dealt = side.drop("cells").join(sizes, [*key]).withColumn(own, F.pmod(F.xxhash64("class", F.lit(own)), F.col(f"{own}_blocks")))
        dealt = dealt.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_blocks") - 1)))
        return dealt.select(*[F.col(c).alias(c) for c in ("class", "rows", "dim", "vector", "label", "cell", "home", "visit")])

    cell = ("label", "dim", "cell", "home", "visit")
    found = (
        blocks(visits, "visit", "home")
        .groupBy(*cell)
        .cogroup(blocks(homes, "home", "visit").groupBy(*cell))
        .applyInArrow(lambda a, b: _cell_links(a, b, cosine), "id long, n long, other long")
    )
    found = durable(found)
    counts = found.groupBy(F.col("id").alias("class")).agg(F.sum("n").alias("n"))
    components = connected_components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    known = classes.join(counts, "class", "left").join(components.withColumnRenamed("node", "class"), "class", "left")
    known = known.select(
        "label",
        "vector",
        (F.coalesce("n", F.lit(0)) + F.col("rows") - 1).alias("n_links"),
        F.coalesce("component", "class").alias("component"),
    )
    linked = rows.where(part).join(known, ["label", "vector"], "left").select("id", "n_links", "component")
    alone = rows.where(~part).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(False)))
