"""Event rows and saved reports from CSV files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators.cleaning import clean_for_batch, clean_for_dashboard
from eventloom.schema import EVENT_COLUMNS, EVENT_SCHEMA, MISSING_WORDS, RAW_SCHEMA
from eventloom.sources.csv_records import read_records

PATH_NOT_FOUND = "PATH_NOT_FOUND"


def read_raw_events(
    spark: SparkSession, path: str | list[str], sep: str = ",", quote: str = '"', line_breaks: bool = False
) -> DataFrame:
    """The 19 columns as text, null where a file writes a word for a missing value.

    The header must name them in order. A record with more or fewer fields is an
    error when it is read; so is a line break inside quotes, which would cut a
    record in two, unless ``line_breaks`` allows them. Such files are split as
    well, see ``csv_records``, at the cost of two shuffles of their lines.
    """
    if line_breaks:
        raw = read_records(spark, path, RAW_SCHEMA, sep, quote)
    else:
        raw = (
            spark.read.schema(RAW_SCHEMA)
            .options(header=True, sep=sep, quote=quote, escape=quote, enforceSchema=False)
            .options(mode="FAILFAST", columnPruning=False)  # else fields that no query asks for are not looked at
            .csv(path)
        )
    present = {name: F.when(~F.col(name).isin(*MISSING_WORDS), F.col(name)) for name in EVENT_COLUMNS}
    return raw.withColumns(present)


def load_batch_events(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """Events for the batch report; a missing file is an error."""
    return clean_for_batch(read_raw_events(spark, path, line_breaks=line_breaks))


def load_dashboard_events(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """Events for the dashboard; a missing file is an empty table."""
    try:
        raw = read_raw_events(spark, path, line_breaks=line_breaks)
    except AnalysisException as error:
        if error.getCondition() != PATH_NOT_FOUND:
            raise
        return spark.createDataFrame([], EVENT_SCHEMA)
    return clean_for_dashboard(raw)


def load_report(spark: SparkSession, path: str) -> DataFrame | None:
    """A report saved as CSV with a header, or None where there is none."""
    try:
        return spark.read.options(header=True, inferSchema=True).csv(path)
    except AnalysisException as error:
        if error.getCondition() != PATH_NOT_FOUND:
            raise
        return None
