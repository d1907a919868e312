"""Time between an event and the next one of its session, and statistics over it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import percent
from ..functions.times import elapsed_us, naive, seconds, valid_dwell
from ..spec import EventSpec
from .ordering import in_order
from .statistics import percentiles


def with_dwell(
    events: DataFrame, spec: EventSpec, columns: Iterable[str], keep_unknown: bool = True
) -> DataFrame:
    """The given columns and dwell_us, the microseconds to the next event of the session.

    The last event of a session, and one without a session, has none. A table that holds dwell
    times, as the clean event table does, needs no ordering any more.
    """
    if "dwell_us" in events.columns:
        timed = events.select(*columns, "dwell_us")
        return timed if keep_unknown else timed.filter(F.col("dwell_us").isNotNull())
    needed = dict.fromkeys(("id", "session_id", "create_ts", *columns))
    return with_next(events.select(*needed), spec, keep_unknown).select(*columns, "dwell_us")


def with_next(events: DataFrame, spec: EventSpec, keep_unknown: bool = True) -> DataFrame:
    """Add next_ts, the time of the session's next event, and dwell_us, the microseconds to it."""
    ordered = in_order(events, spec, keep_unknown).neighbour({"next_ts": "create_ts"}, 1)
    return ordered.plain().withColumn("dwell_us", elapsed_us(F.col("create_ts"), F.col("next_ts")))


def not_homepage(spec: EventSpec) -> Column:
    """The link is none of the home page spellings; a null link is not one either."""
    if not spec.homepages:
        return F.lit(True)
    return F.coalesce(~F.col("link").isin(*spec.homepages), F.lit(True))


def dwell_events(events: DataFrame, spec: EventSpec) -> DataFrame:
    """Every event with its successor's time and its own dwell time in seconds."""
    needed = events.select("id", "session_id", "profile_id", "name", "link", "create_ts")
    return with_next(needed, spec).select(
        "id",
        "session_id",
        "profile_id",
        "name",
        "link",
        naive(F.col("create_ts")).alias("create_ts"),
        naive(F.col("next_ts")).alias("next_ts"),
        seconds(F.col("dwell_us")).alias("duration_sec"),
    )


def valid_events(
    events: DataFrame, spec: EventSpec, columns: Iterable[str], exclude_home: bool = True
) -> DataFrame:
    """Events with a dwell time in (0, cap], away from the home page unless told otherwise."""
    timed = with_dwell(events, spec, columns, keep_unknown=False)
    timed = timed.filter((F.col("dwell_us") > 0) & (F.col("dwell_us") <= spec.cap_us))
    return timed.filter(not_homepage(spec)) if exclude_home else timed


ACTIVE_COLUMNS = (
    "id session_id profile_id name type journey_state link page_title product_name product_ref "
    "create_ts utm_source utm_medium utm_campaign device_type geo_country geo_city"
).split()


def active_events(events: DataFrame, spec: EventSpec, exclude_home: bool = True) -> DataFrame:
    """The event-level dwell output: 17 descriptive columns of the valid events, and the id."""
    active = valid_events(events, spec, ACTIVE_COLUMNS, exclude_home)
    return active.select(
        *ACTIVE_COLUMNS[:10],
        naive(F.col("create_ts")).alias("create_ts"),
        seconds(F.col("dwell_us")).alias("duration_sec"),
        *ACTIVE_COLUMNS[11:],
    )


def link_dwell(events: DataFrame, spec: EventSpec, exclude_home: bool = True) -> DataFrame:
    """Dwell statistics per link over the valid events."""
    columns = ("session_id", "profile_id", "link")
    active = valid_events(events, spec, columns, exclude_home).filter(F.col("link").isNotNull())
    totals = active.groupBy("link").agg(
        F.count(F.lit(1)).alias("views"),
        F.count_distinct("session_id").alias("unique_sessions"),
        F.count_distinct("profile_id").alias("unique_users"),
        F.sum("dwell_us").alias("us"),
    )
    middle = percentiles(active, ["link"], "dwell_us", {"median_us": 0.5, "p90_us": 0.9})
    return totals.join(middle, "link").select(
        "link",
        "views",
        "unique_sessions",
        "unique_users",
        seconds(F.col("us")).alias("total_time_sec"),
        (seconds(F.col("us")) / F.col("views")).alias("avg_time_sec"),
        seconds(F.col("median_us")).alias("median_time_sec"),
        seconds(F.col("p90_us")).alias("p90_time_sec"),
    )


def event_dwell(events: DataFrame, spec: EventSpec) -> DataFrame:
    """Per event name: how many, how many measured, and average, median, p90 and total seconds.

    A name that was never measured has zeros, as for a sum over nothing.
    """
    timed = with_dwell(events, spec, ["name"]).filter(F.col("name").isNotNull())
    timed = timed.withColumn("us", valid_dwell(F.col("dwell_us"), spec.cap_us))
    totals = timed.groupBy("name").agg(
        F.count(F.lit(1)).alias("events_total"),
        F.count("us").alias("events_measured"),
        F.coalesce(F.sum("us"), F.lit(0)).alias("us"),
    )
    middle = percentiles(timed, ["name"], "us", {"median_us": 0.5, "p90_us": 0.9})

    def rounded(value: Column) -> Column:
        return F.round(F.coalesce(value, F.lit(0.0)), 2)

    return totals.join(middle, "name", "left").select(
        "name",
        "events_total",
        "events_measured",
        rounded(F.try_divide(seconds(F.col("us")), F.col("events_measured"))).alias("avg_sec"),
        rounded(seconds(F.col("median_us"))).alias("median_sec"),
        rounded(seconds(F.col("p90_us"))).alias("p90_sec"),
        rounded(seconds(F.col("us"))).alias("total_sec"),
        percent(F.col("events_measured"), F.col("events_total"), 1).alias("coverage_pct"),
    )
