"""Ratios, rounding and number display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division; null where the denominator is zero or null."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio_or(numerator: Column, denominator: Column, default: float = 0.0) -> Column:
    """Double division with ``default`` where the denominator is zero or null."""
    usable = denominator.isNotNull() & (denominator != 0)
    return F.when(usable, ratio(numerator, denominator)).otherwise(F.lit(default))


def change_pct(current: Column, previous: Column) -> Column:
    """Percent change; null where there is nothing to compare with."""
    return 100.0 * ratio(current - previous, previous)


def half_even(value: Column, digits: int) -> Column:
    """Array-library rounding: scale, round to the even neighbour, scale back."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def exact_round(value: Column, digits: int) -> Column:
    """Rounding of the exact binary value, ties to even."""
    return fixed(value, digits).cast("double")


def grouped(value: Column, digits: int) -> Column:
    """``1,234.50``."""
    return F.format_number(value, digits)


def fixed(value: Column, digits: int) -> Column:
    """``1234.50``."""
    return F.translate(F.format_number(value, digits), ",", "")


def signed(value: Column, digits: int) -> Column:
    """``+12.5`` or ``-3.1``."""
    text = fixed(value, digits)
    return F.when(text.startswith("-"), text).otherwise(F.concat(F.lit("+"), text))


def currency_label(value: Column, symbol: str = "$") -> Column:
    """``$4.1M``, ``$12.3K``, ``$950.00``; a missing value is ``$0``."""
    size = F.abs(value)
    text = (
        F.when(size >= 1_000_000, F.concat(fixed(size / 1_000_000, 1), F.lit("M")))
        .when(size >= 1_000, F.concat(fixed(size / 1_000, 1), F.lit("K")))
        .otherwise(grouped(size, 2))
    )
    sign = F.when(value < 0, "-").otherwise("")
    return F.coalesce(F.concat(sign, F.lit(symbol), text), F.lit(f"{symbol}0"))


def number_label(value: Column) -> Column:
    """``4.1M``, ``12.3K``, ``950``; a missing value is ``0``."""
    size = F.abs(value)
    text = (
        F.when(size >= 1_000_000, F.concat(fixed(size / 1_000_000, 1), F.lit("M")))
        .when(size >= 1_000, F.concat(fixed(size / 1_000, 1), F.lit("K")))
        .otherwise(grouped(size, 0))
    )
    return F.coalesce(F.concat(F.when(value < 0, "-").otherwise(""), text), F.lit("0"))


def percent_label(value: Column, digits: int = 1) -> Column:
    """``12.3%``; a missing value is ``0%``."""
    return F.coalesce(F.concat(fixed(value, digits), F.lit("%")), F.lit("0%"))


def compact_label(value: Column, prefix: str = "", suffix: str = "") -> Column:
    """``1.13M``, ``42.6K``; below a thousand whole numbers lose their decimals."""
    value = value.cast("double")
    size = F.abs(value)
    text = (
        F.when(size >= 1_000_000_000, F.concat(fixed(value / 1_000_000_000, 2), F.lit("B")))
        .when(size >= 1_000_000, F.concat(fixed(value / 1_000_000, 2), F.lit("M")))
        .when(size >= 1_000, F.concat(fixed(value / 1_000, 1), F.lit("K")))
        .when(value == F.floor(value), grouped(value, 0))
        .otherwise(grouped(value, 2))
    )
    return F.concat(F.lit(prefix), text, F.lit(suffix))


def first_present(*values: Column, default: Column | None = None) -> Column:
    return F.coalesce(*values, *([] if default is None else [default]))
