from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.errors import AnalysisException

from eventloom.operators import cleaning
from eventloom.schema import EVENT_COLUMNS, EVENT_SCHEMA
from eventloom.sources.csv_events import load_batch_events, load_dashboard_events, load_report, read_raw_events
from eventloom.sources.tables import import_events

HEADER = ",".join(EVENT_COLUMNS)
LINE = "{user},s1,{day},2025-01-01 10:00:00,India,{city},Mobile,Android,{version},Direct,New,{event},{duration},{revenue},{level},5.00,Free,{campaign},7"


def line(**changes) -> str:
    values = {
        "user": "u1", "day": "2025-01-01", "city": "Pune", "version": "v1", "event": "Purchase", "duration": "60",
        "revenue": "5.00", "level": "0", "campaign": "Spring",
    }
    return LINE.format(**{**values, **changes})


@pytest.fixture
def csv(tmp_path):
    def write(*lines: str) -> str:
        path = tmp_path / "events.csv"
        path.write_text("\n".join([HEADER, *lines]) + "\n")
        return str(path)

    return write


MESSY = (
    line(),
    line(),  # exact duplicate
    line(city='" Pune "'),  # differs by blanks: stays, and is stripped
    line(user="u2", day="not a day"),
    line(user="", event="Search"),
    line(user="u3", duration="long", revenue="x", level="?"),
    line(user="u4", city="", version="", campaign="", revenue="-3.50"),
    line(user="u5", duration="86400"),
    line(user="u6", event=""),
    line(user="u7", duration="-5", city='"Port ""A"", East"'),
)


def test_batch_profile(spark, csv):
    clean = {(r["user_id"], r["city"]): r for r in rows(load_batch_events(spark, csv(*MESSY)))}
    everyone = load_batch_events(spark, csv(*MESSY))
    assert everyone.count() == 6  # u1 twice, u3, u4, u5, u7
    assert everyone.where("user_id = 'u1' and city = 'Pune'").count() == 2
    broken = clean["u3", "Pune"]
    assert (broken["session_duration"], broken["revenue"], broken["level_completed"]) == (0.0, Decimal("0.00"), 0)
    bare = clean["u4", "Unknown"]
    assert (bare["app_version"], bare["campaign"], bare["revenue"]) == ("Unknown", "None", Decimal("0.00"))
    # durations after dedup: 60, 60, 0, 60, 86400, -5; p99 lies above an hour
    assert clean["u5", "Pune"]["session_duration"] == 3600.0
    assert clean["u7", 'Port "A", East']["session_duration"] == 0.0


def test_cap_uses_the_percentile_where_it_is_lower(make_events):
    events = make_events(*[{"session_duration": d} for d in [10] * 99 + [900]])
    cap = cleaning.duration_cap(events).first().cap
    assert cap == pytest.approx(10 + 890 * 0.01)
    assert max(r["session_duration"] for r in rows(cleaning.cap_durations(events))) == cap


def test_report_counts(spark, csv):
    report = rows(cleaning.cleaning_report(read_raw_events(spark, csv(*MESSY))))[0]
    assert report == {
        "rows_in": 10, "dropped_incomplete": 3, "duplicates_removed": 1, "durations_capped": 1, "rows_out": 6,
        "unread_event_date": 1, "unread_event_timestamp": 0, "unread_session_duration": 1, "unread_revenue": 1,
        "unread_level_completed": 1, "unread_purchase_amount": 0, "unread_retention_day": 0,
    }


def test_dashboard_profile_keeps_duplicates_and_outliers(spark, csv):
    events = load_dashboard_events(spark, csv(*MESSY))
    assert events.count() == 8  # without the bad date and the missing user
    assert events.where("session_duration = 86400").count() == 1
    assert events.where("user_id = 'u3' and level_completed is null").count() == 1


def test_import_profile_keeps_every_row(spark, csv, tmp_path):
    events = import_events(spark, csv(*MESSY), str(tmp_path / "table"))
    assert events.columns == EVENT_COLUMNS
    assert events.count() == 10
    assert events.where("event_date is null").count() == 1
    assert events.where("campaign is null or city is null or revenue is null").count() == 0


def test_null_strings_become_text(make_events):
    stripped = rows(cleaning.strip_strings(make_events({"country": None, "os": "\t iOS  "})))[0]
    assert (stripped["country"], stripped["os"]) == ("nan", "iOS")


def test_missing_files(spark, tmp_path):
    nowhere = str(tmp_path / "nowhere.csv")
    with pytest.raises(AnalysisException):
        load_batch_events(spark, nowhere)
    assert load_report(spark, nowhere) is None
    empty = load_dashboard_events(spark, nowhere)
    assert empty.schema == EVENT_SCHEMA and empty.isEmpty()


def test_other_separator(spark, csv, tmp_path):
    path = tmp_path / "semicolons.csv"
    path.write_text("\n".join([HEADER, line()]).replace(",", ";") + "\n")
    raw = read_raw_events(spark, str(path), sep=";")
    assert rows(cleaning.cast_columns(raw))[0]["event_date"] == date(2025, 1, 1)


def test_large_numbers_are_kept(spark, csv):
    clean = rows(load_batch_events(spark, csv(line(revenue="123456789012.50", level="3000000000"))))[0]
    assert (clean["revenue"], clean["level_completed"]) == (Decimal("123456789012.50"), 2**31 - 1)


def test_words_for_missing_values(spark, csv):
    found = rows(load_batch_events(spark, csv(line(city="NA", version="nan", campaign="NULL", revenue="N/A"))))[0]
    assert (found["city"], found["app_version"], found["campaign"], found["revenue"]) == ("Unknown", "Unknown", "None", Decimal("0.00"))


def test_line_breaks_inside_quotes(spark, csv, tmp_path):
    path = csv(line(), line(user="u2", city='"Po\nrt, ""A"""'), line(user="u3"))
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        load_batch_events(spark, path).collect()
    events = import_events(spark, path, str(tmp_path / "table"), line_breaks=True)
    assert {r["user_id"]: r["city"] for r in rows(events)} == {"u1": "Pune", "u2": 'Po\nrt, "A"', "u3": "Pune"}


def test_surplus_fields_are_an_error(spark, csv):
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        read_raw_events(spark, csv(line(), line() + ",more")).select("user_id").collect()


def test_header_only_and_bad_dates(spark, csv, tmp_path):
    assert import_events(spark, csv(), str(tmp_path / "none")).count() == 0
    events = import_events(spark, csv(line(day="?"), line(day="??")), str(tmp_path / "bad"))
    assert events.schema["event_date"].dataType.typeName() == "date" and events.count() == 2


def test_every_blank_is_stripped(make_events):
    from eventloom.schema import BLANKS

    texts = [f"{blank}a{blank}b{blank}" for blank in BLANKS] + ["\u200bx", f"{BLANKS}"]
    stripped = rows(cleaning.strip_strings(make_events(*[{"user_id": f"{i:03}", "city": t} for i, t in enumerate(texts)])))
    assert {r["user_id"]: r["city"] for r in stripped} == {f"{i:03}": t.strip() for i, t in enumerate(texts)}
