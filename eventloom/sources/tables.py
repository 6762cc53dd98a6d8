"""The event table as parquet, partitioned by day."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eventloom.operators.cleaning import clean_for_import, rejected_values
from eventloom.schema import EVENT_COLUMNS, EVENT_SCHEMA, KEY_COLUMNS, NUMERIC_COLUMNS
from eventloom.session import durable
from eventloom.sources.csv_events import PATH_NOT_FOUND, read_raw_events
from eventloom.sources.versions import VersionedFolder


def _write_part(events: DataFrame, path: str) -> None:
    """Rows are rebalanced by day first: small days share a file, and a day with a large part of all rows is split over several tasks."""
    events.hint("rebalance", F.col("event_date")).write.partitionBy("event_date").parquet(path)


def write_events(events: DataFrame, path: str) -> None:
    """Replace the table at ``path``, whose date filters then read only their days.

    The old rows stay until the new ones are all written, see ``versions``, so that a job that fails, and a reader at any
    moment, finds a whole table. ``events`` may come from the table itself.
    """
    folder = VersionedFolder(events.sparkSession, path)
    before, part = folder.newest(), folder.new_part()
    _write_part(events, folder.part_path(part))
    folder.publish(before, (part,))


def read_events(spark: SparkSession, path: str, schema: StructType = EVENT_SCHEMA) -> DataFrame:
    """The table at ``path``; its schema is known, so no file is opened to find it."""
    return VersionedFolder(spark, path).read(schema).select(*EVENT_COLUMNS)


def import_events(
    spark: SparkSession, csv_path: str, path: str, line_breaks: bool = False, quarantine_path: str | None = None
) -> DataFrame:
    """Load a CSV file into the table, replacing what was there, and return it.

    With ``quarantine_path`` the values that did not fit their columns are written there, see ``rejected_values``.
    """
    raw = read_raw_events(spark, csv_path, line_breaks=line_breaks)
    if quarantine_path:
        rejected_values(raw).write.mode("overwrite").parquet(quarantine_path)
    write_events(clean_for_import(raw), path)
    return read_events(spark, path)


FILES_SCHEMA = "name string, length long, modified timestamp, content string, part string"


def _listed(spark: SparkSession, csv_path: str) -> DataFrame:
    """``(name, uri, length, modified)`` of the CSV files; their contents are not opened."""
    files = spark.read.format("binaryFile").load(csv_path)
    return files.select(F.col("path").alias("name"), F.col("_metadata.file_path").alias("uri"), "length", F.col("modificationTime").alias("modified"))


def _contents(spark: SparkSession, names: list[str]) -> DataFrame:
    """``(uri, content)``: line count and two sums of line hashes for each file, taken by all tasks; equal files have equal ones."""
    if not names:
        return spark.createDataFrame([], "uri string, content string")
    lines = spark.read.option("lineSep", "\n").text(names).select(F.col("_metadata.file_path").alias("uri"), "value")
    # Lines in another order are the same rows, so sums without order are enough.
    second = F.sum(F.xxhash64(F.lit(1), "value").cast("decimal(20,0)"))
    sums = lines.groupBy("uri").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("value")).alias("a"), second.alias("b"))
    return sums.select("uri", F.concat_ws(" ", "n", "a", "b").alias("content"))


def import_new_events(spark: SparkSession, csv_path: str, path: str, line_breaks: bool = False) -> DataFrame:
    """Bring the table up to the CSV files now at ``csv_path``, reading only those that it does not have, and return it.

    The table remembers each file's name, length, time and content. Files that are there as before are not opened; one
    with a new time is, and counts as the same if its content is. Rows of files that changed or went are replaced: the parts
    of the table that hold them are written again from their other files. The result is that of ``import_events``, and like
    it the change is one step. Rows of a table that was written otherwise go.
    """
    folder = VersionedFolder(spark, path)
    before = folder.newest()
    known = spark.read.schema(FILES_SCHEMA).parquet(folder.files_path(before.files)) if before.files else spark.createDataFrame([], FILES_SCHEMA)
    listed = _listed(spark, csv_path)
    old = known.select("name", *[F.col(c).alias(f"old_{c}") for c in ("length", "modified", "content", "part")])
    both = durable(listed.join(old, "name", "full"))
    same = (F.col("length") == F.col("old_length")) & (F.col("modified") == F.col("old_modified"))

    # File names are handled by the driver as in any read of a folder; only those to be opened are collected.
    opened = [r.name for r in both.where(F.col("length").isNotNull() & ~F.coalesce(same, F.lit(False))).select("name").collect()]
    contents = durable(_contents(spark, opened))
    seen = both.join(contents, "uri", "left").withColumn(
        "same", F.coalesce(same, F.lit(False)) | F.coalesce((F.col("length") == F.col("old_length")) & (F.col("content") == F.col("old_content")), F.lit(False))
    )
    seen = durable(seen)
    stale = seen.where(F.col("old_part").isNotNull() & ~F.col("same")).select(F.col("old_part").alias("stale")).distinct()
    marked = durable(seen.join(stale, F.col("old_part") == F.col("stale"), "left"))
    read = marked.where(F.col("length").isNotNull() & (~F.col("same") | F.col("stale").isNotNull()))
    names = [r.name for r in read.select("name").collect()]
    gone = {r.stale for r in stale.collect()}
    recorded = {r.old_part for r in known.select(F.col("part").alias("old_part")).distinct().collect()}
    kept = tuple(p for p in before.parts if p in recorded and p not in gone)
    if not names and kept == before.parts and before.files and not opened:
        return read_events(spark, path)

    part, files = folder.new_part(), folder.new_part()
    if names:
        _write_part(clean_for_import(read_raw_events(spark, names, line_breaks=line_breaks)), folder.part_path(part))
    new = F.col("old_part").isNull() | ~F.col("same") | F.col("stale").isNotNull()
    ledger = marked.where(F.col("length").isNotNull()).select(
        "name", "length", "modified", F.coalesce("content", "old_content").alias("content"), F.when(new, F.lit(part)).otherwise(F.col("old_part")).alias("part")
    )
    ledger.write.parquet(folder.files_path(files))
    folder.publish(before, (*kept, part) if names else kept, files)
    return read_events(spark, path)


def row_count(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("n"))


def is_filled(spark: SparkSession, path: str) -> bool:
    """Whether there is a table at ``path`` with at least one row."""
    try:
        return not read_events(spark, path).isEmpty()
    except AnalysisException as error:
        if error.getCondition() not in (PATH_NOT_FOUND, "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False


def ensure_events(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """Build the table where it is missing or empty, or on demand."""
    if force or not is_filled(spark, path):
        write_events(build(), path)
    return read_events(spark, path)


def table_ddl(name: str) -> str:
    columns = []
    for field in EVENT_SCHEMA:
        line = f"{field.name} {field.dataType.simpleString().upper()}"
        if field.name in (*KEY_COLUMNS, "event_timestamp"):
            line += " NOT NULL"
        elif field.name in NUMERIC_COLUMNS:
            line += " DEFAULT 0"
        columns.append(line)
    body = ",\n  ".join(columns)
    return f"CREATE TABLE {name} (\n  {body}\n) USING parquet PARTITIONED BY (event_date)"


def create_events_table(spark: SparkSession, database: str, table: str = "user_events") -> None:
    """Create the database if needed and an empty table in place of any old one."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    spark.sql(f"DROP TABLE IF EXISTS {database}.{table}")
    spark.sql(table_ddl(f"{database}.{table}"))
