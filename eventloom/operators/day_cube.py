"""A day cube: daily partial sums and exact user sets, from which reports of any period and dimension are read.

1. Events of the wanted periods are reduced once to rows by (period, day, user and all dimensions together).
2. Users get numbers without gaps, so that a set of users is a bitmap: one bit a user, in buckets of 32,768.
3. ``amounts`` has the sums by (period, day, dimension, segment), ``people`` the users, payers and buyers as bitmaps.

Sums add up and bitmaps join by "or" over days and months, so that the events, and the users of a day, are never shuffled
again for another report. Sessions and session durations are counted in a pass each.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.keys import month_key, weekday_name
from eventloom.functions.measures import PER_USER, sql_columns
from eventloom.functions.numbers import ratio
from eventloom.functions.quantiles import quantiles_of
from eventloom.operators.segments import segment_rows
from eventloom.schema import FUNNEL_STAGES
from eventloom.session import durable

ALL = "all"  # the dimension whose only segment is everything
PEOPLE = (ALL, "country", "device_type", "campaign", "event_name")  # dimensions whose users are asked for
AMOUNTS = (*PEOPLE, "traffic_source", "subscription", "os", "city")
SUMS = ("events", "named_events", "revenue", "purchases", "payments", "paid", "duration", "timed_events")
SETS = {"users": "true", "payers": "has_payment", "buyers": "has_purchase"}
WHOLE = "now"  # the period of a cube that was asked for none


def _numbered(users: DataFrame) -> DataFrame:
    """``users``, written once, with numbers from 1 without gaps: rows of a partition in turn, after those of the partitions before it."""
    marked = durable(users.withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    # One row for each partition, whatever the users.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = marked.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    starts = sizes.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    place = F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("start") + 1
    return marked.withColumn("part", part).join(F.broadcast(starts), "part").select(*users.columns, place.alias("number"))


@dataclass(frozen=True)
class DayCube:
    """Partial results by day; ``DayCube.of`` makes one from events.

    ``people(period, day, dimension, segment, bucket, users, payers, buyers)`` holds bitmaps, null where nobody is in one,
    and ``users(user_id, number, first_<period>)`` the kind of each user's first event in time by period.
    Rows without a day keep a null day: they count in totals, not among days or months.
    """

    amounts: DataFrame
    people: DataFrame
    users: DataFrame
    sessions: DataFrame
    durations: DataFrame

    @classmethod
    def of(cls, events: DataFrame, periods: Mapping[str, Column] | None = None) -> DayCube:
        """The cube of the events in ``periods``, by name the condition for each; an event in several is in the first."""
        name = F.lit(WHOLE) if periods is None else None
        for period, condition in (periods or {}).items():
            name = F.when(condition, period) if name is None else name.when(condition, period)
        tagged = events.withColumn("period", name).where(F.col("period").isNotNull()).withColumn(ALL, F.lit(""))
        measures = {n: PER_USER[n] for n in (*SUMS, "has_payment", "has_purchase", "first_kind")}
        days = tagged.groupBy("period", F.col("event_date").alias("day"), "user_id", *AMOUNTS).agg(*sql_columns(measures))
        days = durable(days)
        amounts = segment_rows(days, AMOUNTS, "period", "day", *SUMS).groupBy("period", "day", "dimension", "segment")
        known = days.where(F.col("user_id").isNotNull())
        firsts = [F.min(F.when(F.col("period") == p, F.col("first_kind"))).alias(f"first_{p}") for p in (periods or [WHOLE])]
        users = _numbered(known.groupBy("user_id").agg(*firsts))
        rows = known.select("user_id", "period", "day", *PEOPLE, *[F.expr(x).alias(s) for s, x in SETS.items()]).join(users, "user_id")
        rows = rows.withColumns({"bucket": F.bitmap_bucket_number("number"), "bit": F.bitmap_bit_position("number")})
        people = segment_rows(rows, PEOPLE, "period", "day", "bucket", "bit", *SETS).groupBy("period", "day", "dimension", "segment", "bucket")

        def members(which: str) -> Column:
            return F.when(F.max(which), F.bitmap_construct_agg(F.when(F.col(which), F.col("bit")))).alias(which)

        return cls(
            durable(amounts.agg(*[F.sum(s).alias(s) for s in SUMS])),
            durable(people.agg(*[members(s) for s in SETS])),
            users,
            tagged.groupBy("period").agg(F.count_distinct("session_id").alias("sessions")),
            tagged.where(F.col("session_duration").isNotNull()).groupBy("period", F.col("session_duration").alias("value")).agg(F.count("*").alias("rows")),
        )

    def counted(self, *keys: Column | str, dimension: str = ALL, period: str = WHOLE, sets: tuple[str, ...] = ("users",)) -> DataFrame:
        """``(keys, sets)``: how many different people are in each set by keys of ``people``."""
        chosen = self.people.where((F.col("period") == period) & (F.col("dimension") == dimension))
        joined = chosen.groupBy(*keys, "bucket").agg(*[F.bitmap_or_agg(s).alias(s) for s in sets])
        names = [c for c in joined.columns if c not in ("bucket", *sets)]
        return joined.groupBy(*names).agg(*[F.sum(F.bitmap_count(s)).alias(s) for s in sets])

    @cached_property
    def _totals(self) -> DataFrame:
        """One row for each period with events: sums, days, months and people."""
        month = month_key(F.col("day")).alias("month")
        whole = self.amounts.where(F.col("dimension") == ALL).groupBy("period", month)
        whole = whole.agg(*[F.sum(s).alias(s) for s in SUMS], F.count("day").alias("days")).groupBy("period")
        sums = [F.sum(s).alias(s) for s in SUMS]
        whole = whole.agg(*sums, F.sum("days").alias("calendar_days"), F.count("month").alias("calendar_months"))

        # People of days, which are there, of months and of all, each from the one before.
        stage = (F.col("dimension") == "event_name") & F.col("segment").isin(list(FUNNEL_STAGES))
        sets = self.people.where((F.col("dimension") == ALL) | stage).groupBy("period", "segment", "bucket", month)
        both = [F.bitmap_or_agg(s).alias(s) for s in ("users", "payers")]
        sets = sets.agg(*both, F.sum(F.when(F.col("day").isNotNull(), F.bitmap_count("users"))).alias("user_days"))
        months = F.sum(F.when(F.col("month").isNotNull(), F.bitmap_count("users"))).alias("user_months")
        sets = sets.groupBy("period", "segment", "bucket").agg(*both, F.sum("user_days").alias("user_days"), months)

        def of(segment: str, count: Column, name: str) -> Column:
            return F.sum(F.when(F.col("segment") == segment, count)).alias(name)

        users = F.bitmap_count("users")
        people = sets.groupBy("period").agg(
            of("", F.col("user_days"), "user_days"),
            of("", F.col("user_months"), "user_months"),
            of("", users, "users"),
            of("", F.bitmap_count("payers"), "has_payment"),
            *[of(name, users, f"stage_{i}") for i, name in enumerate(FUNNEL_STAGES)],
        )
        kinds = [c for c in self.users.columns if c.startswith("first_")]
        returning = self.users.agg(*[F.count_if(F.expr(f"pmod({c}, 4) = 2")).alias(c) for c in kinds])
        returning = returning.unpivot([], kinds, "period", "returning").withColumn("period", F.substring("period", len("first_") + 1, 1000))
        # Each table has some columns of a period's row; the others are null there.
        parts = [whole, people, returning, self.sessions]
        names = [c for part in parts for c in part.columns if c != "period"]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part, allowMissingColumns=True)
        return rows.groupBy("period").agg(*[F.max(c).alias(c) for c in names])

    def period_totals(self, periods: tuple[str, ...] = (WHOLE,)) -> DataFrame:
        """A row of plain totals for each period asked for, zero where there are no events."""
        names = [c for c in self._totals.columns if c != "period"]
        listed = F.explode(F.array(*[F.lit(p) for p in periods])).alias("period")
        rows = self.amounts.sparkSession.range(1).select(listed).join(self._totals, "period", "left")
        return rows.select("period", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in names])

    def segment_totals(self, period: str = WHOLE) -> DataFrame:
        """``(dimension, segment, revenue, events)`` of all dimensions and of the days of the week."""
        rows = self.amounts.where(F.col("period") == period)
        weekdays = rows.where((F.col("dimension") == ALL) & F.col("day").isNotNull())
        weekdays = weekdays.withColumns({"dimension": F.lit("weekday"), "segment": weekday_name(F.col("day"))})
        both = rows.where(F.col("dimension") != ALL).unionByName(weekdays)
        return both.groupBy("dimension", "segment").agg(F.sum("revenue").cast("double").alias("revenue"), F.sum("events").alias("events"))

    def segment_summary(self, dimension: str, period: str = WHOLE) -> DataFrame:
        """Users, named events, revenue and mean session duration by value of one dimension, largest revenue first."""
        rows = self.amounts.where((F.col("period") == period) & (F.col("dimension") == dimension)).groupBy("segment")
        sums = rows.agg(F.sum("named_events").alias("events"), F.sum("revenue").cast("double").alias("revenue"),
                        F.sum("duration").cast("double").alias("duration"), F.sum("timed_events").alias("timed"))
        users = self.counted("segment", dimension=dimension, period=period)
        joined = sums.join(users, "segment", "left")
        seconds = F.try_divide("duration", "timed").alias("avg_session_duration")
        return joined.select(
            F.col("segment").alias(dimension), F.coalesce("users", F.lit(0)).alias("users"), "events", "revenue", seconds
        ).orderBy(F.desc("revenue"), dimension)

    def device_conversion(self, period: str = WHOLE) -> DataFrame:
        """One row ``(low, segment)``: the device with the largest share of purchasing users."""
        counts = self.counted("segment", dimension="device_type", period=period, sets=("users", "buyers")).where(F.col("buyers") > 0)
        rate = ratio(F.col("buyers"), F.col("users")) * 100
        return counts.agg(F.min(F.struct((-rate).alias("low"), "segment")))

    def active_users(self, key: Column, period: str = WHOLE) -> DataFrame:
        """``(key, users)`` by a key of the day, for all days with events; zero where no event has a user."""
        rows = self.amounts.where((F.col("period") == period) & F.col("day").isNotNull() & (F.col("dimension") == ALL))
        counts = self.counted(key.alias("key"), period=period)
        # A day without users has no people; it is there with zero.
        both = counts.where(F.col("key").isNotNull()).unionByName(rows.select(key.alias("key"), F.lit(0).cast("long").alias("users")))
        return both.groupBy("key").agg(F.max("users").alias("users"))

    def median_duration(self, period: str = WHOLE) -> DataFrame:
        return quantiles_of(self.durations.where(F.col("period") == period).select("value", "rows"), {"median": 0.5})
