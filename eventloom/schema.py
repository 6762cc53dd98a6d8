"""The event table: one row per event, 19 columns."""

from __future__ import annotations

from pyspark.sql import types as T

# The columns of an event.
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("event_date", T.DateType()),
        T.StructField("event_timestamp", T.TimestampNTZType()),
        T.StructField("country", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("device_type", T.StringType()),
        T.StructField("os", T.StringType()),
        T.StructField("app_version", T.StringType()),
        T.StructField("traffic_source", T.StringType()),
        T.StructField("user_type", T.StringType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("session_duration", T.IntegerType()),
        T.StructField("revenue", T.DecimalType(18, 2)),
        T.StructField("level_completed", T.IntegerType()),
        T.StructField("purchase_amount", T.DecimalType(18, 2)),
        T.StructField("subscription", T.StringType()),
        T.StructField("campaign", T.StringType()),
        T.StructField("retention_day", T.IntegerType()),
    ]
)

EVENT_COLUMNS = EVENT_SCHEMA.fieldNames()
STRING_COLUMNS = [f.name for f in EVENT_SCHEMA if isinstance(f.dataType, T.StringType)]

# A file is first read as text, so that a bad date or number can become null
# in one column without losing the row.
RAW_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in EVENT_COLUMNS])

# Names and limits that results depend on.
PURCHASE = "Purchase"
RETURNING = "Returning"
NO_CAMPAIGN = "None"
UNKNOWN = "Unknown"
FUNNEL_STAGES = ("App Open", "Search", "Add to Cart", "Purchase")
CATEGORY_DEFAULTS = {"city": "Unknown", "app_version": "Unknown", "campaign": "None"}
NUMERIC_COLUMNS = ("session_duration", "revenue", "level_completed", "purchase_amount", "retention_day")
KEY_COLUMNS = ("user_id", "session_id", "event_date", "event_name")
SEGMENT_DIMENSIONS = (
    "country", "city", "device_type", "os", "traffic_source", "campaign", "subscription", "user_type", "retention_day",
)
MAX_SESSION_SECONDS = 3600
COHORT_DAYS = (1, 3, 7, 14, 30)
# What a CSV file may write for a missing value.
MISSING_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Blanks at either end of a text that do not count.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
