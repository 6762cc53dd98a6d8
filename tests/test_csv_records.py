"""Records with line breaks, read by many tasks, equal those that one task reads."""

from __future__ import annotations

import csv
import random

import pytest

from eventloom.schema import EVENT_COLUMNS, RAW_SCHEMA
from eventloom.sources.csv_events import read_raw_events
from eventloom.sources.csv_records import csv_records, read_records

TEXTS = ["plain", "", "two\nlines", 'a "quoted" word', "\n\n", '"', ",", 'x,"\n', "   ", "é日本\nß", "ends\n", '""\n""', "\n" * 40]


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def written(path, rows, sep=",", end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as file:
        out = csv.writer(file, delimiter=sep, lineterminator=end)
        out.writerows([EVENT_COLUMNS, *rows])
    return str(path)


def made(seed, n):
    random.seed(seed)
    return [[f"u{i}", *[random.choice(TEXTS) for _ in EVENT_COLUMNS[1:]]] for i in range(n)]


def test_many_splits_equal_one_task_and_python(spark, tmp_path, small_splits):
    folder = tmp_path / "csv"
    folder.mkdir()
    rows = made(1, 150)
    written(folder / "a.csv", rows[:100])
    written(folder / "b.csv", rows[100:], end="\r\n")
    read = read_records(spark, str(folder), RAW_SCHEMA)
    lines = csv_records(spark, str(folder))
    assert lines.select("file", "block").distinct().count() > 30 and lines.count() == 152
    found = sorted(tuple(x or "" for x in r) for r in read.collect())
    assert found == sorted(map(tuple, rows))
    one = spark.read.schema(RAW_SCHEMA).options(header=True, quote='"', escape='"', multiLine=True, mode="FAILFAST").csv(str(folder / "a.csv"))
    assert sorted(tuple(x or "" for x in r) for r in one.collect()) == sorted(map(tuple, rows[:100]))


def test_a_record_longer_than_many_splits(spark, tmp_path, small_splits):
    rows = [["u0", "\n".join(f"line {i}" for i in range(2000)), *["x"] * 17], *made(2, 5)]
    path = written(tmp_path / "long.csv", rows, sep="|")
    read = read_raw_events(spark, path, sep="|", line_breaks=True).select("user_id", "session_id")
    assert {r.user_id: r.session_id or "" for r in read.collect()} == {r[0]: r[1] for r in rows}


def test_blank_lines_and_header_only(spark, tmp_path):
    path = tmp_path / "blank.csv"
    path.write_text("\n \n" + ",".join(EVENT_COLUMNS) + "\n\n" + ",".join(["a"] * 19) + "\n\n\n" + ",".join(['"b\n\n"'] * 19) + "\n\n")
    assert sorted(r.city for r in read_raw_events(spark, str(path), line_breaks=True).collect()) == ["a", "b\n\n"]
    assert read_raw_events(spark, written(tmp_path / "none.csv", []), line_breaks=True).count() == 0


@pytest.mark.parametrize(("text", "error"), [
    (",".join(EVENT_COLUMNS) + "\n" + ",".join(["a"] * 18 + ['"open']) + "\n" + ",".join(["b"] * 19) + "\n", "do not pair"),
    (",".join(EVENT_COLUMNS) + "\n" + ",".join(["a"] * 20) + "\n", "MALFORMED|FAILFAST"),
    (",".join(EVENT_COLUMNS) + "\n" + ",".join(["a"] * 18) + "\n", "MALFORMED|FAILFAST"),
    (",".join(reversed(EVENT_COLUMNS)) + "\n" + ",".join(["a"] * 19) + "\n", "header"),
])
def test_files_that_are_not_right_are_errors(spark, tmp_path, text, error):
    path = tmp_path / "wrong.csv"
    path.write_text(text)
    with pytest.raises(Exception, match=error):
        read_raw_events(spark, str(path), line_breaks=True).collect()
