"""Three ways to turn raw event rows into typed, usable events.

``clean_for_batch`` removes duplicates and outliers, ``clean_for_dashboard``
only types and fills, ``clean_for_import`` keeps every row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.quantiles import quantiles
from eventloom.schema import (
    BLANKS,
    CATEGORY_DEFAULTS,
    EVENT_COLUMNS,
    EVENT_SCHEMA,
    KEY_COLUMNS,
    MAX_SESSION_SECONDS,
    NUMERIC_COLUMNS,
    STRING_COLUMNS,
)


MOST_INT = 2**31 - 1


def cast_columns(raw: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Cast to the schema's types; what cannot be read becomes null, a count too large the largest.

    ``rejected_values`` lists such values beside the typed table.
    """
    return raw.withColumns({name: _safe_cast(raw, name) for name in columns or raw.columns})


def _safe_cast(raw: DataFrame, name: str) -> Column:
    wanted = EVENT_SCHEMA[name].dataType
    value = F.col(name)
    if wanted.typeName() == "integer" and raw.schema[name].dataType.typeName() == "string":
        value = value.try_cast("double")  # "12.0" is a number too
        inside = F.greatest(F.least(value, F.lit(MOST_INT)), F.lit(-MOST_INT - 1))  # both skip nulls
        value = F.when(value.isNotNull() & ~F.isnan(value), inside)
    return value.try_cast(wanted.simpleString())


def _reason(raw: DataFrame, name: str) -> Column:
    """Why a value does not fit its column as it is; null where it does or is missing."""
    value, wanted = F.col(name), EVENT_SCHEMA[name].dataType
    cast = value.try_cast(wanted.simpleString())
    unreadable = F.when(value.isNotNull() & _safe_cast(raw, name).isNull(), "unreadable")
    if wanted.typeName() not in ("integer", "decimal") or raw.schema[name].dataType.typeName() != "string":
        return unreadable
    exact = F.btrim(value).try_cast("decimal(38,10)")
    number = value.try_cast("double")
    if wanted.typeName() == "decimal":
        large = number.isNotNull() & cast.isNull() & ~F.isnan(number)
        return F.when(large, "too large").when(exact != cast, "rounded").otherwise(unreadable)
    large = (number > F.lit(MOST_INT)) | (number < F.lit(-MOST_INT - 1))
    return F.when(large & ~F.isnan(number), "too large").when(number != F.floor(number), "fraction cut").otherwise(unreadable)


def rejected_values(raw: DataFrame) -> DataFrame:
    """``(column, reason, value)`` and the row's columns, as text, for each value that the typed table does not hold as it is.

    Reasons: ``unreadable`` values are missing in the table; numbers ``too large`` are the largest that fits (counts) or
    missing (amounts); of counts a ``fraction`` is ``cut``; amounts are ``rounded`` to cents. Missing values are no rejects.
    One pass, no shuffle: a row comes once for each such value.
    """
    read = [name for name in EVENT_COLUMNS if name not in STRING_COLUMNS]
    found = F.array_compact(
        F.array(*[
            F.when(_reason(raw, n).isNotNull(), F.struct(F.lit(n).alias("column"), _reason(raw, n).alias("reason"), F.col(n).cast("string").alias("value")))
            for n in read
        ])
    )
    texts = [F.col(n).cast("string").alias(n) for n in EVENT_COLUMNS]
    return raw.select(F.explode(found).alias("rejected"), *texts).select("rejected.*", *EVENT_COLUMNS)


def rejected_counts(raw: DataFrame) -> DataFrame:
    """``(column, reason, n)`` over ``rejected_values``."""
    return rejected_values(raw).groupBy("column", "reason").agg(F.count("*").alias("n"))


def fill_categories(events: DataFrame) -> DataFrame:
    return events.na.fill(CATEGORY_DEFAULTS)


def fill_numbers(events: DataFrame, columns: Sequence[str] = NUMERIC_COLUMNS) -> DataFrame:
    return events.na.fill(0, list(columns))


def drop_incomplete(events: DataFrame, columns: Sequence[str] = KEY_COLUMNS) -> DataFrame:
    return events.na.drop(subset=list(columns))


def drop_duplicate_rows(events: DataFrame) -> DataFrame:
    return events.dropDuplicates()


def duration_cap(events: DataFrame) -> DataFrame:
    """One row ``cap``: the 99th percentile of session duration, at most an hour."""
    p99 = quantiles(events, "session_duration", {"p99": 0.99})
    return p99.select(F.least("p99", F.lit(float(MAX_SESSION_SECONDS))).alias("cap"))


def cap_durations(events: DataFrame) -> DataFrame:
    cap = duration_cap(events).scalar()
    clipped = F.least(F.greatest(F.col("session_duration").cast("double"), F.lit(0.0)), cap)
    return events.withColumn("session_duration", clipped)


def floor_amounts(events: DataFrame, columns: Sequence[str] = ("revenue", "purchase_amount")) -> DataFrame:
    zero = F.lit(0).cast("decimal(18,2)")
    return events.withColumns({name: F.greatest(F.col(name), zero) for name in columns})


def strip_strings(events: DataFrame) -> DataFrame:
    """Strip whitespace at both ends; a null becomes the text ``nan``."""

    def strip(name: str) -> Column:
        return F.coalesce(F.btrim(name, F.lit(BLANKS)), F.lit("nan"))

    return events.withColumns({name: strip(name) for name in STRING_COLUMNS})


def _deduplicated(raw: DataFrame) -> DataFrame:
    complete = drop_incomplete(fill_categories(cast_columns(raw)))
    return drop_duplicate_rows(fill_numbers(complete))


def clean_for_batch(raw: DataFrame) -> DataFrame:
    """Type, fill, drop rows without keys, deduplicate, cap, floor and strip.

    The cap is taken over deduplicated rows, and stripping comes last: rows that
    differ only in blanks both stay.
    """
    return strip_strings(floor_amounts(cap_durations(_deduplicated(raw))))


def clean_for_dashboard(raw: DataFrame) -> DataFrame:
    """Type and fill; rows without date or user are dropped."""
    numbers = [name for name in NUMERIC_COLUMNS if name != "level_completed"]
    filled = fill_categories(fill_numbers(cast_columns(raw), numbers))
    return drop_incomplete(filled, ["event_date", "user_id"])


def clean_for_import(raw: DataFrame) -> DataFrame:
    """Type and fill; every row is kept."""
    return fill_categories(fill_numbers(cast_columns(raw)))


def cleaning_report(raw: DataFrame) -> DataFrame:
    """One row: rows in and out, dropped, duplicates removed, durations capped and, by column, values that could not be read or are too large."""
    typed = fill_categories(cast_columns(raw))
    read = [name for name in EVENT_COLUMNS if name not in STRING_COLUMNS]
    unread = raw.agg(*[F.count_if(_reason(raw, name).isin("unreadable", "too large")).alias(f"unread_{name}") for name in read])
    complete = F.lit(True)
    for name in KEY_COLUMNS:
        complete = complete & F.col(name).isNotNull()
    before = typed.agg(F.count(F.lit(1)).alias("rows_in"), F.count_if(complete).alias("rows_complete"))

    kept = _deduplicated(raw)
    cap = duration_cap(kept).scalar()
    after = kept.agg(
        F.count(F.lit(1)).alias("rows_out"), F.count_if(F.col("session_duration") > cap).alias("durations_capped")
    )
    counts = after.select(
        "*", before.select(F.struct("*")).scalar().alias("before"), unread.select(F.struct("*")).scalar().alias("unread")
    )
    return counts.select(
        "before.rows_in",
        (F.col("before.rows_in") - F.col("before.rows_complete")).alias("dropped_incomplete"),
        (F.col("before.rows_complete") - F.col("rows_out")).alias("duplicates_removed"),
        "durations_capped",
        "rows_out",
        *[f"unread.unread_{name}" for name in read],
    )
