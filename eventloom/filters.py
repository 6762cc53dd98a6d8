"""One filter model for every operator."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from datetime import date, timedelta
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Filter name -> event column.
FILTER_COLUMNS = {
    "countries": "country",
    "devices": "device_type",
    "campaigns": "campaign",
    "user_types": "user_type",
    "subscriptions": "subscription",
    "traffic_sources": "traffic_source",
}


def _as_date(value: date | str | None) -> date | None:
    if not value:
        return None
    return value if isinstance(value, date) else date.fromisoformat(value)


@dataclass(frozen=True)
class EventFilters:
    """Inclusive date bounds and allowed values per dimension; empty means all."""

    start_date: date | None = None
    end_date: date | None = None
    countries: tuple[str, ...] = ()
    devices: tuple[str, ...] = ()
    campaigns: tuple[str, ...] = ()
    user_types: tuple[str, ...] = ()
    subscriptions: tuple[str, ...] = ()
    traffic_sources: tuple[str, ...] = ()

    @classmethod
    def from_dict(cls, values: Mapping[str, Any] | None) -> EventFilters:
        """``{"start_date", "end_date", "countries", ...}``."""
        values = values or {}
        lists = {name: tuple(values.get(name) or ()) for name in FILTER_COLUMNS}
        return cls(_as_date(values.get("start_date")), _as_date(values.get("end_date")), **lists)

    @classmethod
    def from_selection(cls, selection: Mapping[str, Any]) -> EventFilters:
        """``{"date_range": (start, end), "countries", ...}``.

        A range that is not a pair (a date picker halfway through) is ignored.
        """
        chosen = {name: selection.get(name) for name in FILTER_COLUMNS}
        span = selection.get("date_range")
        if isinstance(span, (tuple, list)) and len(span) == 2:
            chosen["start_date"], chosen["end_date"] = span
        return cls.from_dict(chosen)

    def predicate(self) -> Column:
        """True, or the conjunction of all set conditions. Never null where unset."""
        conditions = []
        if self.start_date:
            conditions.append(F.col("event_date") >= F.lit(self.start_date))
        if self.end_date:
            conditions.append(F.col("event_date") <= F.lit(self.end_date))
        for name, column in FILTER_COLUMNS.items():
            if allowed := getattr(self, name):
                conditions.append(F.col(column).isin(*allowed))
        return reduce(Column.__and__, conditions, F.lit(True))

    def apply(self, events: DataFrame) -> DataFrame:
        return events.where(self.predicate())

    def previous_period(self) -> EventFilters | None:
        """The period of equal length right before this one; None without a range."""
        if not (self.start_date and self.end_date):
            return None
        last = self.start_date - timedelta(days=1)
        return replace(self, start_date=last - (self.end_date - self.start_date), end_date=last)


def select(events: DataFrame, filters: EventFilters | None) -> DataFrame:
    return filters.apply(events) if filters else events


def in_scope(filters: EventFilters | None) -> Column:
    return filters.predicate() if filters else F.lit(True)


def filter_options(events: DataFrame) -> DataFrame:
    """Rows ``(dimension, value)``: every value a filter can take, in order."""
    return (
        events.select(*FILTER_COLUMNS.values())
        .unpivot([], list(FILTER_COLUMNS.values()), "dimension", "value")
        .where(F.col("value").isNotNull())
        .distinct()
        .orderBy("dimension", "value")
    )


def date_bounds(events: DataFrame) -> DataFrame:
    return events.agg(F.min("event_date").alias("min_date"), F.max("event_date").alias("max_date"))
