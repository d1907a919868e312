"""Views by source, device, system, destination, place and time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import count_true, percent, ratio
from ..spec import EventSpec, FilterSpec


# ---- time ---------------------------------------------------------------------------------------


def _activity(events: DataFrame, spec: EventSpec, keys: Sequence[str], views_only: bool) -> DataFrame:
    """Views and intent events per key in one pass. Hours with neither are absent."""
    view = F.col("name") == spec.view_event
    intent = F.col("name").isin(*spec.intent_events)
    known = F.col("hour_local").isNotNull() & (view | intent)
    counts = (
        events.filter(known)
        .groupBy(*keys)
        .agg(count_true(view).alias("page_views"), count_true(intent).alias("intent_events"))
    )
    return counts.filter(F.col("page_views") > 0) if views_only else counts


def hourly_activity(events: DataFrame, spec: EventSpec, views_only: bool = False) -> DataFrame:
    """Page views and intent events per local date and hour.

    `views_only` leaves out hours that had intent events but no page view.
    """
    return _activity(events, spec, ("date_local", "hour_local"), views_only)


def hour_of_day(events: DataFrame, spec: EventSpec, views_only: bool = False) -> DataFrame:
    return _activity(events, spec, ("hour_local",), views_only)


def hour_of_day_rate(hourly: DataFrame, filters: FilterSpec | None = None) -> DataFrame:
    """Hour-of-day totals of the hourly table with the intent rate. The table has dates, no other parts of a filter."""
    if filters is not None:
        hourly = filters.apply(hourly, date_column="date_local")
    totals = hourly.groupBy("hour_local").agg(
        F.sum("page_views").alias("page_views"), F.sum("intent_events").alias("intent_events")
    )
    return totals.withColumn(
        "intent_rate_pct", percent(F.col("intent_events"), F.col("page_views"), 2)
    )


# ---- destinations and places --------------------------------------------------------------------


def _destination_views(events: DataFrame, spec: EventSpec) -> DataFrame:
    return events.filter(F.col("destination").isNotNull() & (F.col("name") == spec.view_event))


def destinations(events: DataFrame, spec: EventSpec) -> DataFrame:
    """Views, sessions and users per destination, device and source of the event, nulls kept."""
    return (
        _destination_views(events, spec)
        .groupBy("destination", "device_type", "utm_source")
        .agg(
            F.count("id").alias("views"),
            F.count_distinct("session_id").alias("sessions"),
            F.count_distinct("profile_id").alias("users"),
        )
    )


def top_destinations(
    events: DataFrame, spec: EventSpec, filters: FilterSpec | None = None, limit: int = 30
) -> DataFrame:
    """The most viewed destinations with exact distinct sessions and users; a filter's dates are local."""
    views = _destination_views(events, spec)
    if filters is not None:
        views = filters.apply(views, date_column="date_local")
    return (
        views.groupBy("destination")
        .agg(
            F.count("id").alias("views"),
            F.count_distinct("session_id").alias("unique_sessions"),
            F.count_distinct("profile_id").alias("unique_users"),
        )
        .orderBy(F.desc("views"), "destination")
        .limit(limit)
    )


def top_destinations_summed(
    table: DataFrame, filters: FilterSpec | None = None, limit: int = 15
) -> DataFrame:
    """Top destinations from the slice table: sessions and users in several slices count in each."""
    if filters is not None:
        table = filters.apply(table)
    return (
        table.groupBy("destination")
        .agg(*(F.sum(c).alias(c) for c in ("views", "sessions", "users")))
        .orderBy(F.desc("views"), "destination")
        .limit(limit)
    )


def geo(events: DataFrame, limit: int = 30) -> DataFrame:
    """Countries and cities with the most sessions; events of an unknown place are left out."""
    return (
        events.filter(F.col("geo_country").isNotNull() & F.col("geo_city").isNotNull())
        .groupBy("geo_country", "geo_city")
        .agg(F.count_distinct("session_id").alias("sessions"), F.count("id").alias("events"))
        .orderBy(F.desc("sessions"), "geo_country", "geo_city")
        .limit(limit)
    )


# ---- sources ------------------------------------------------------------------------------------


def utm_sources(sessions: DataFrame, spec: EventSpec) -> DataFrame:
    """Sessions, step sessions and rates per source and device, nulls kept."""
    cart, order, success = spec.conversion_flags
    n = F.col("sessions")
    return (
        sessions.groupBy("utm_source", "device_type")
        .agg(
            F.count(F.lit(1)).alias("sessions"),
            count_true(F.col(cart)).alias("atc_count"),
            count_true(F.col(order)).alias("order_count"),
            count_true(F.col(success)).alias("success_count"),
        )
        .withColumn("atc_rate_pct", percent(F.col("atc_count"), n, 3))
        .withColumn("order_rate_pct", percent(F.col("order_count"), n, 3))
    )


def utm_conversion(sessions: DataFrame, spec: EventSpec) -> DataFrame:
    """Rates and average events per source, largest source first."""
    cart, order, _ = spec.conversion_flags
    n = F.count(F.lit(1))
    return (
        sessions.groupBy("utm_source")
        .agg(
            n.alias("sessions"),
            percent(count_true(F.col(cart)), n, 2).alias("atc_rate_pct"),
            percent(count_true(F.col(order)), n, 2).alias("order_rate_pct"),
            F.round(ratio(F.sum("num_events"), n), 2).alias("avg_events"),
        )
        .orderBy(F.desc("sessions"), F.asc_nulls_last("utm_source"))
    )


def utm_performance(
    table: DataFrame, spec: EventSpec, filters: FilterSpec | None = None, limit: int = 10
) -> DataFrame:
    """The largest sources of the source table over all (or one) device, labelled, by cart rate."""
    if filters is not None:
        table = filters.apply(table)
    top = (
        table.groupBy("utm_source")
        .agg(
            F.sum("sessions").alias("sessions"),
            F.sum("atc_count").alias("atc"),
            F.sum("order_count").alias("order"),
        )
        .orderBy(F.desc("sessions"), F.asc_nulls_last("utm_source"))
        .limit(limit)
    )
    source = F.coalesce("utm_source", F.lit(spec.direct_label))
    size = F.format_number("sessions", 0)
    return top.select(
        source.alias("utm_source"),
        "sessions",
        "atc",
        "order",
        percent(F.col("atc"), F.col("sessions"), 2).alias("atc_pct"),
        percent(F.col("order"), F.col("sessions"), 2).alias("order_pct"),
        F.concat(source, F.lit(" ("), size, F.lit(")")).alias("label"),
    ).orderBy("atc_pct", "utm_source")


# ---- devices ------------------------------------------------------------------------------------


def _minutes_sum() -> Column:
    """Session minutes as whole hundredths, so that the sum does not depend on its order."""
    return F.sum(F.round(F.col("session_duration_min") * 100).cast("long"))


def _average_minutes() -> Column:
    return ratio(_minutes_sum(), F.count("session_duration_min")) / 100


def _with_share(by_device: DataFrame) -> DataFrame:
    """Each row's share of all sessions, largest first."""
    total = by_device.agg(F.sum("sessions").alias("total")).scalar()
    return by_device.withColumn("share_pct", percent(F.col("sessions"), total, 2)).orderBy(
        F.desc("sessions"), F.asc_nulls_last("device_type")
    )


def device_os(sessions: DataFrame, spec: EventSpec) -> DataFrame:
    """Sessions, step sessions, averages and rates per device and system, nulls kept."""
    cart, order, _ = spec.conversion_flags
    n = F.count(F.lit(1))
    return sessions.groupBy("device_type", "os_name").agg(
        n.alias("sessions"),
        count_true(F.col(cart)).alias("atc_count"),
        count_true(F.col(order)).alias("order_count"),
        F.round(ratio(F.sum("num_events"), n), 2).alias("avg_events"),
        F.round(_average_minutes(), 2).alias("avg_duration_min"),
        percent(count_true(F.col(cart)), n, 3).alias("atc_rate_pct"),
        percent(count_true(F.col(order)), n, 3).alias("order_rate_pct"),
    )


def device_share(sessions: DataFrame, spec: EventSpec) -> DataFrame:
    """Per device: sessions, share of all, rates, and averages weighted by session."""
    cart, order, _ = spec.conversion_flags
    n = F.count(F.lit(1))
    return _with_share(
        sessions.groupBy("device_type").agg(
            n.alias("sessions"),
            percent(count_true(F.col(cart)), n, 3).alias("atc_rate_pct"),
            percent(count_true(F.col(order)), n, 3).alias("order_rate_pct"),
            F.round(ratio(F.sum("num_events"), n), 2).alias("avg_events"),
            F.round(_average_minutes(), 2).alias("avg_duration_min"),
        )
    )


def device_share_unweighted(table: DataFrame) -> DataFrame:
    """Per device from the device-system table, its averages being means over the systems' means."""
    n = F.sum("sessions")
    return _with_share(
        table.groupBy("device_type").agg(
            n.alias("sessions"),
            percent(F.sum("atc_count"), n, 3).alias("atc_rate_pct"),
            percent(F.sum("order_count"), n, 3).alias("order_rate_pct"),
            F.round(F.avg("avg_events"), 2).alias("avg_events"),
            F.round(F.avg("avg_duration_min"), 2).alias("avg_duration_min"),
        )
    )


def os_breakdown(sessions: DataFrame, spec: EventSpec, limit: int = 10) -> DataFrame:
    """The systems with the most sessions, with their events; an unknown one is labelled so."""
    return (
        sessions.groupBy("os_name")
        .agg(F.sum("num_events").alias("events"), F.count(F.lit(1)).alias("sessions"))
        .orderBy(F.desc("sessions"), F.asc_nulls_last("os_name"))
        .limit(limit)
        .withColumn("os_name", F.coalesce("os_name", F.lit(spec.unknown_label)))
    )
