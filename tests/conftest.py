from __future__ import annotations

import sys
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from eventloom.schema import EVENT_SCHEMA  # noqa: E402
from eventloom.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[8]")
        .appName("eventloom-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.retainedJobs", "1000000")  # test_scans looks stages up after very many others
        .config("spark.ui.retainedStages", "1000000")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
    )
    session = configure(builder).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


DEFAULTS = {
    "session_id": "s1",
    "event_date": date(2025, 1, 1),
    "country": "India",
    "city": "Pune",
    "device_type": "Mobile",
    "os": "Android",
    "app_version": "v1",
    "traffic_source": "Direct",
    "user_type": "New",
    "event_name": "App Open",
    "session_duration": 60,
    "revenue": Decimal("0.00"),
    "level_completed": 0,
    "purchase_amount": Decimal("0.00"),
    "subscription": "Free",
    "campaign": "None",
    "retention_day": 1,
}


@pytest.fixture(scope="session")
def make_events(spark):
    """Events from short dicts; ``paid`` makes a purchase of that amount."""

    def make(*rows: dict) -> DataFrame:
        full = []
        for i, row in enumerate(rows):
            event = {"user_id": f"u{i}", **DEFAULTS, **row}
            paid = event.pop("paid", None)
            if paid is not None:
                event.update(event_name="Purchase", revenue=Decimal(paid), purchase_amount=Decimal(paid))
            if isinstance(event["event_date"], str):
                event["event_date"] = date.fromisoformat(event["event_date"])
            day = event["event_date"]
            if "event_timestamp" not in event:
                event["event_timestamp"] = datetime(day.year, day.month, day.day, 12) if day else None
            full.append(tuple(event[name] for name in EVENT_SCHEMA.fieldNames()))
        return spark.createDataFrame(full, EVENT_SCHEMA)

    return make


def rows(table: DataFrame) -> list[dict]:
    return [row.asDict() for row in table.collect()]
