from __future__ import annotations

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.functions import keys, numbers
from eventloom.functions.quantiles import quantiles


def test_calendar_keys_over_many_years(spark):
    days = [date(1999, 1, 1) + timedelta(days=i) for i in range(12_000)]
    table = spark.createDataFrame([(d,) for d in days], "d date").select(
        "d",
        keys.monday_week_key(F.col("d")).alias("week"),
        keys.iso_week_number(F.col("d")).alias("iso"),
        keys.week_span(F.col("d")).alias("span"),
        keys.weekday_name(F.col("d")).alias("weekday"),
    )
    for row in table.collect():
        iso = row.d.isocalendar()
        monday = row.d - timedelta(days=row.d.weekday())
        assert row.week == row.d.strftime("%Y-W%W")
        assert row.iso == iso.year * 100 + iso.week
        assert row.span == f"{monday}/{monday + timedelta(days=6)}"
        assert row.weekday == row.d.strftime("%A")


@pytest.mark.parametrize(
    ("value", "currency", "number", "compact"),
    [
        (None, "$0", "0", None),
        (0.0, "$0.00", "0", "0"),
        (12.5, "$12.50", "12", "12.50"),
        (-950.0, "-$950.00", "-950", "-950"),
        (1234.0, "$1.2K", "1.2K", "1.2K"),
        (-1_500_000.0, "-$1.5M", "-1.5M", "-1.50M"),
        (2_345_678_901.0, "$2345.7M", "2345.7M", "2.35B"),
    ],
)
def test_labels(spark, value, currency, number, compact):
    row = spark.createDataFrame([(value,)], "v double").select(
        numbers.currency_label(F.col("v")), numbers.number_label(F.col("v")), numbers.compact_label(F.col("v"))
    ).first()
    assert tuple(row) == (currency, number, compact)


def test_rounding_follows_numpy_and_python(spark):
    rng = random.Random(5)
    values = [rng.uniform(-100, 100) for _ in range(500)] + [k / 8 for k in range(-80, 80)] + [0.025, 1.005, 2.675]
    table = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", numbers.half_even(F.col("v"), 2).alias("np"), numbers.exact_round(F.col("v"), 2).alias("py"),
        numbers.fixed(F.col("v"), 1).alias("text"), numbers.signed(F.col("v"), 2).alias("signed"),
    )
    for row in table.collect():
        assert row.np == np.round(row.v, 2)
        assert row.py == round(row.v, 2)
        assert row.text == f"{row.v:.1f}"
        assert row.signed == f"{row.v:+.2f}"


def test_ratios(spark):
    row = spark.createDataFrame([(6.0, 0.0, None)], "a double, z double, n double").select(
        numbers.ratio(F.col("a"), F.col("z")), numbers.ratio_or(F.col("a"), F.col("n"), 7.0),
        numbers.change_pct(F.col("a"), F.col("z")), numbers.change_pct(F.col("a"), F.lit(4.0)),
        numbers.first_present(F.col("n"), default=F.col("a")),
    ).first()
    assert tuple(row) == (None, 7.0, None, 50.0, 6.0)


@pytest.mark.parametrize("size", [1, 2, 3, 10, 101, 5000])
def test_quantiles_match_numpy(spark, size):
    rng = random.Random(size)
    values = [rng.choice([rng.randrange(100), rng.randrange(-70_000, 3_000_000), 86_400]) for _ in range(size)]
    table = spark.createDataFrame([(v,) for v in [*values, None]], "v int")
    row = quantiles(table, "v", {"p0": 0.0, "half": 0.5, "p99": 0.99, "all": 1.0}).first()
    for name, q in (("p0", 0), ("half", 0.5), ("p99", 0.99), ("all", 1)):
        assert row[name] == pytest.approx(np.quantile(values, q), rel=1e-12)


def test_quantile_of_nothing_is_null(spark):
    assert quantiles(spark.createDataFrame([], "v int"), "v", {"m": 0.5}).first().m is None
