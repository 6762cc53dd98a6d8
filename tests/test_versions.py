"""Tables are replaced in one step, and only files that are new are imported."""

from __future__ import annotations

import os
from datetime import date
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from eventloom.operators import cleaning
from eventloom.schema import EVENT_COLUMNS
from eventloom.sources import tables
from eventloom.sources.csv_events import read_raw_events
from eventloom.sources.versions import ConcurrentChange, VersionedFolder
from test_cleaning import HEADER, line


@pytest.fixture
def events(make_events):
    return make_events(*[{"event_date": date(2025, 1, 1 + i % 5)} for i in range(20)])


def users(table):
    return sorted(r.user_id for r in table.collect())


def parts(path):
    return sorted(p.name for p in Path(path, "data").iterdir())


def test_a_failed_write_keeps_the_old_rows(spark, events, tmp_path):
    path = str(tmp_path / "events")
    tables.write_events(events, path)
    broken = events.withColumn("city", F.when(F.col("user_id") == "u13", F.raise_error(F.lit("lost"))).otherwise(F.col("city")))
    with pytest.raises(Exception, match="lost"):
        tables.write_events(broken, path)
    assert users(tables.read_events(spark, path)) == users(events)
    assert VersionedFolder(spark, path).newest().number == 1


def test_readers_go_on_with_the_version_they_know(spark, events, tmp_path):
    path = str(tmp_path / "events")
    tables.write_events(events, path)
    reader = tables.read_events(spark, path)
    tables.write_events(events.where("user_id > 'u3'"), path)
    assert users(reader) == users(events)
    # From the table itself, which an overwrite in place could not do.
    tables.write_events(tables.read_events(spark, path).where("user_id > 'u5'"), path)
    assert users(tables.read_events(spark, path)) == ["u6", "u7", "u8", "u9"]
    tables.write_events(events, path)
    assert len(parts(path)) == 2 and len(list(Path(path, "_manifests").glob("[0-9]*.json"))) == 2


def test_two_writers(spark, events, tmp_path):
    folder = VersionedFolder(spark, str(tmp_path / "events"))
    before = folder.newest()
    tables.write_events(events, folder.path)
    with pytest.raises(ConcurrentChange):
        folder.publish(before, ("other",))
    assert tables.read_events(spark, folder.path).count() == 20


def test_a_plain_folder_is_a_table_until_it_is_replaced(spark, events, tmp_path):
    path = str(tmp_path / "events")
    events.write.partitionBy("event_date").parquet(path)
    assert users(tables.read_events(spark, path)) == users(events)
    tables.write_events(events.limit(3), path)
    assert tables.read_events(spark, path).count() == 3


@pytest.fixture
def opened(monkeypatch):
    """Names of the files that are read as CSV."""
    names = []

    def read(spark, path, **options):
        names.append(sorted(Path(p).name for p in path))
        return read_raw_events(spark, path, **options)

    monkeypatch.setattr(tables, "read_raw_events", read)
    return names


def test_only_new_files_are_read(spark, tmp_path, opened):
    source, path = tmp_path / "csv", str(tmp_path / "events")
    source.mkdir()

    def put(name, *lines, at=None):
        (source / name).write_text("\n".join([HEADER, *lines]) + "\n")
        if at:
            os.utime(source / name, (at, at))

    def load():
        opened.clear()
        found = tables.import_new_events(spark, str(source), path)
        assert sorted(map(str, found.collect())) == sorted(map(str, cleaning.clean_for_import(read_raw_events(spark, str(source))).select(*EVENT_COLUMNS).collect()))
        return list(opened)

    put("a one.csv", line(user="a"), line(user="a"))
    put("b.csv", line(user="b", day="2025-01-02"))
    assert load() == [["a one.csv", "b.csv"]]
    number = VersionedFolder(spark, path).newest().number
    assert load() == [] and VersionedFolder(spark, path).newest().number == number
    put("c.csv", line(user="c"))
    assert load() == [["c.csv"]]
    put("c.csv", line(user="c"), at=2_000_000_000)  # a new time, the same content
    assert load() == []
    put("c.csv", line(user="d"), at=2_000_000_100)  # the same length, other content
    assert load() == [["c.csv"]] and users(tables.read_events(spark, path)) == ["a", "a", "b", "d"]
    put("b.csv", line(user="b"), line(user="e"))  # its part also holds the first file, which is read again
    assert load() == [["a one.csv", "b.csv"]]
    (source / "c.csv").unlink()
    assert load() == [] and users(tables.read_events(spark, path)) == ["a", "a", "b", "e"]
    for name in ("a one.csv", "b.csv"):
        (source / name).unlink()
    assert tables.import_new_events(spark, str(source), path).count() == 0
    tables.write_events(cleaning.clean_for_import(read_raw_events(spark, _one(tmp_path))), path)
    put("a one.csv", line(user="a"))
    assert load() == [["a one.csv"]]  # rows that came otherwise went


def _one(folder):
    path = folder / "other.csv"
    path.write_text("\n".join([HEADER, line(user="z")]) + "\n")
    return str(path)


def test_a_failed_import_is_no_import(spark, tmp_path):
    source, path = tmp_path / "csv", str(tmp_path / "events")
    source.mkdir()
    (source / "a.csv").write_text("\n".join([HEADER, line(user="a")]) + "\n")
    tables.import_new_events(spark, str(source), path)
    (source / "b.csv").write_text("\n".join([HEADER, line(user="b") + ",more"]) + "\n")
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        tables.import_new_events(spark, str(source), path)
    assert users(tables.read_events(spark, path)) == ["a"]
    (source / "b.csv").write_text("\n".join([HEADER, line(user="b")]) + "\n")
    assert users(tables.import_new_events(spark, str(source), path)) == ["a", "b"]


def test_rejected_values_lie_beside_the_table(spark, tmp_path):
    path = tmp_path / "odd.csv"
    lines = [
        line(user="u1", level="3000000000", duration="12.7"), line(user="u2", revenue="5.005", day="never"), line(user="u3", level="12.0", duration="-1"),
        line(user="u4", revenue="1e40", level="NaN"), line(user="u5", level="1e300", duration="-3000000000"), line(user="u6", level="many", revenue="NA"),
    ]
    path.write_text("\n".join([HEADER, *lines]) + "\n")
    table = tables.import_events(spark, str(path), str(tmp_path / "table"), quarantine_path=str(tmp_path / "quarantine"))
    found = spark.read.parquet(str(tmp_path / "quarantine"))
    assert sorted((r.user_id, r.column, r.reason, r.value) for r in found.collect()) == [
        ("u1", "level_completed", "too large", "3000000000"), ("u1", "session_duration", "fraction cut", "12.7"),
        ("u2", "event_date", "unreadable", "never"), ("u2", "revenue", "rounded", "5.005"),
        ("u4", "revenue", "too large", "1e40"),
        ("u5", "level_completed", "too large", "1e300"), ("u5", "session_duration", "too large", "-3000000000"),
        ("u6", "level_completed", "unreadable", "many"),
    ]
    assert table.count() == 6 and found.columns == ["column", "reason", "value", *EVENT_COLUMNS]
    report = rows(cleaning.cleaning_report(read_raw_events(spark, str(path))))[0]
    assert (report["unread_level_completed"], report["unread_session_duration"], report["unread_revenue"], report["unread_event_date"]) == (3, 1, 1, 1)
