"""Event tables derived from a star schema of customers, orders and clicks.

Both views return the 19 event columns. Customers get their place names first,
so that a fact row is matched once and not three times. The joins carry no
hints: the optimizer broadcasts a side only after looking at its size, and AQE
splits a customer that holds many events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.schema import CATEGORY_DEFAULTS, EVENT_COLUMNS


# Known schemas spare a job per table that would read them from the files.
TABLES = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,"
    " o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "customer": "c_custkey BIGINT, c_nationkey INT, c_mktsegment STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def _with_places(facts: DataFrame, key: str, spark: SparkSession, folder: str) -> DataFrame:
    customers = (
        _table(spark, folder, "customer")
        .join(_table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(_table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "c_mktsegment", "n_name", "r_name")
    )
    return facts.join(customers, F.col(key) == F.col("c_custkey"))


# Columns both views derive in the same way; {n} is the running number of the fact.
SHARED = {
    "country": "n_name",
    "traffic_source": "r_name",
    "user_type": "CASE WHEN c_custkey % 20 < 7 THEN 'New' ELSE 'Returning' END",
    "session_duration": "CAST(10 + ({n} * 37) % 600 AS INT)",
    "subscription": "CASE WHEN {n} % 10 < 7 THEN 'Free' WHEN {n} % 10 < 9 THEN 'Monthly' ELSE 'Annual' END",
    "retention_day": "element_at(array(1, 3, 7, 14, 30, 60, 90), CAST({n} % 7 AS INT) + 1)",
}

CLICK_COLUMNS = {
    **SHARED,
    "user_id": "concat('USR_', user_id)",
    "session_id": "concat_ws('_', 'SES', user_id, CAST(ts AS DATE), k % 3 + 1)",
    "event_date": "CAST(ts AS DATE)",
    "event_timestamp": "ts",
    "city": "CASE WHEN {n} % 50 <> 0 THEN concat(n_name, '_C', c_custkey % 4) END",
    "device_type": "CASE WHEN k < 70 THEN 'Mobile' WHEN k < 80 THEN 'Tablet' ELSE 'Desktop' END",
    "os": "CASE WHEN k < 45 THEN 'Android' WHEN k < 70 THEN 'iOS' WHEN k < 80 THEN 'iPadOS'"
    " WHEN k < 94 THEN 'Windows' ELSE 'macOS' END",
    "app_version": "CASE WHEN {n} % 67 <> 0 THEN concat('v2.', {n} % 5) END",
    "event_name": "CASE event_type WHEN 'view' THEN 'App Open' WHEN 'click' THEN 'Search'"
    " WHEN 'signup' THEN 'Add to Cart' WHEN 'purchase' THEN 'Purchase' ELSE 'Logout' END",
    "session_duration": f"CASE WHEN {{n}} % 610 = 7 THEN 86400 ELSE {SHARED['session_duration']} END",
    "revenue": "CAST(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END AS DECIMAL(18,2))",
    "level_completed": "CASE WHEN event_type = 'click' THEN k % 50 ELSE 0 END",
    "purchase_amount": "CAST(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END AS DECIMAL(18,2))",
    "campaign": "CASE WHEN {n} % 5 <> 0 THEN c_mktsegment END",
}

ORDER_COLUMNS = {
    **SHARED,
    "user_id": "concat('USR_', o_custkey)",
    "session_id": "concat('SES_', {n})",
    "event_date": "CAST(o_orderdate AS DATE)",
    "event_timestamp": "o_orderdate",
    "city": "concat(n_name, '_C', c_custkey % 4)",
    "device_type": "CASE WHEN {n} % 10 < 7 THEN 'Mobile' WHEN {n} % 10 < 8 THEN 'Tablet' ELSE 'Desktop' END",
    "os": "CASE WHEN {n} % 10 < 5 THEN 'Android' WHEN {n} % 10 < 8 THEN 'iOS' ELSE 'Windows' END",
    "app_version": "concat('v2.', {n} % 5)",
    "event_name": "CASE o_orderstatus WHEN 'F' THEN 'Purchase' WHEN 'O' THEN 'Add to Cart' ELSE 'Search' END",
    "revenue": "CAST(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END AS DECIMAL(18,2))",
    "level_completed": "0",
    "purchase_amount": "CAST(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END AS DECIMAL(18,2))",
    "campaign": "o_orderpriority",
}


def _project(facts: DataFrame, columns: dict[str, str], number: str) -> DataFrame:
    return facts.selectExpr(*[f"{columns[name].format(n=number)} AS {name}" for name in EVENT_COLUMNS])


def click_events_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Events of 30 days with nulls, exact duplicates and outliers."""
    clicks = _with_places(_table(spark, folder, "events"), "user_id", spark, folder).selectExpr(
        "*",
        "try_cast(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k",
        "explode(sequence(1, CASE WHEN event_id % 200 = 0 THEN 2 ELSE 1 END)) AS copy",  # every 200th arrives twice
    )
    return _project(clicks, CLICK_COLUMNS, "event_id")


def click_events(spark: SparkSession, folder: str) -> DataFrame:
    """Click events with category gaps filled as on import."""
    return click_events_raw(spark, folder).na.fill(CATEGORY_DEFAULTS)


def order_events(spark: SparkSession, folder: str) -> DataFrame:
    """One event per order, over several years."""
    orders = _with_places(_table(spark, folder, "orders"), "o_custkey", spark, folder)
    return _project(orders, ORDER_COLUMNS, "o_orderkey")
