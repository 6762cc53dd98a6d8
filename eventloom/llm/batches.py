"""Arrow batches for tasks that run numpy: sizes, and columns as arrays."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows that a Python worker holds at once. Texts can be long, so batches are short.
BATCH_ROWS = "256"


_SHIPPED: set[str] = set()


def short_batches(spark: SparkSession) -> None:
    """Bound the rows of one Arrow batch, so that texts of any length are held a few at a time.

    Also sends this package to the executors, once for each application.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        # On the driver only; executors fetch it from there, as with --py-files.
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name)
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)


def text_rows(docs: DataFrame, id_column: str, text_column: str, *others: Column) -> DataFrame:
    """Only ``id`` and ``text`` (null read as empty), whatever else the table holds."""
    return docs.select(
        F.col(f"`{id_column}`").cast("long").alias("id"),
        F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"),
        *others,
    )


def held_out(ident: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part`` on division by ``parts``; a null id is not held out."""
    return F.coalesce(F.crc32(ident.cast("string")) % parts == part, F.lit(False))


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased and nothing else changed."""
    return text.encode().lower().split()


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str, limit: int) -> Iterator[tuple[pa.Table, bool]]:
    """Whole groups of rows from batches that are sorted by ``key``.

    Yields tables that hold complete groups, with False. A group over ``limit``
    rows comes in pieces, each with True, so that no more than about ``limit``
    rows and one batch are ever held.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    large = None

    def split(table: pa.Table, at: int) -> tuple[pa.Table, pa.Table]:
        return table.slice(0, at), table.slice(at)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        keys = table.column(key).to_numpy()
        if large is not None:
            end = int(np.searchsorted(keys, large, side="right"))
            first, table = split(table, end)
            if first.num_rows:
                yield first, True
            keys = keys[end:]
            if not len(keys):
                held = []
                continue
            large = None
        start = int(np.searchsorted(keys, keys[-1], side="left"))
        if len(keys) - start > limit:
            whole, last = split(table, start)
            if whole.num_rows:
                yield whole, False
            yield last, True
            large, held = keys[-1], []
        elif len(keys) >= limit or start > 20_000:
            whole, last = split(table, start)
            if whole.num_rows:
                yield whole, False
            held = last.combine_chunks().to_batches()
        else:
            held = table.to_batches()
    if held:
        yield pa.Table.from_batches(held), False
