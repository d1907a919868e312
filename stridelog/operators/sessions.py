"""One row per session, and views over those rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import count_true, percent
from ..functions.times import duration_label, elapsed_us, naive, seconds
from ..spec import EventSpec
from .ordering import in_order, split_hot, time_key

FIRST_SEEN = (
    "profile_id",
    "utm_source",
    "utm_medium",
    "utm_campaign",
    "device_type",
    "os_name",
    "geo_country",
    "geo_city",
)


def first_known(column: str, order: Column) -> Column:
    """The column's value in the first row, by `order`, where it is not null."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), order))


def session_rollup(events: DataFrame, spec: EventSpec) -> DataFrame:
    """Session attributes, counts, step flags and length.

    date_utc is the UTC date of the first event, date_local the date at the site.

    Most sessions have few events: their rows are brought together as they are, in one shuffle, as
    the partial results would be wider than the rows. Those of hot sessions are combined first.
    """
    known = events.filter(F.col("session_id").isNotNull())
    if not spec.hot:
        return _rolled(known.repartition("session_id"), spec)
    rest, large = split_hot(known, spec.hot)
    return _rolled(rest.repartition("session_id"), spec).unionByName(_rolled(large, spec))


def _rolled(known: DataFrame, spec: EventSpec) -> DataFrame:
    rolled = known.groupBy("session_id").agg(
        *(first_known(c, time_key()).alias(c) for c in FIRST_SEEN),
        F.min("create_ts").alias("first_ts"),
        F.max("create_ts").alias("last_ts"),
        F.min("date_local").alias("date_local"),
        F.count(F.lit(1)).alias("num_events"),
        F.count_distinct("link").alias("num_unique_links"),
        *(
            F.coalesce(F.bool_or(F.col("name") == s.name), F.lit(False)).alias(s.had)
            for s in spec.steps
        ),
    )
    length = elapsed_us(F.col("first_ts"), F.col("last_ts"))
    return rolled.select(
        "session_id",
        "profile_id",
        naive(F.col("first_ts")).alias("started_at"),
        naive(F.col("last_ts")).alias("ended_at"),
        "num_events",
        "num_unique_links",
        *FIRST_SEEN[1:],
        *(s.had for s in spec.steps),
        F.to_date(naive(F.col("first_ts"))).alias("date_utc"),
        "date_local",
        F.round(length / F.lit(60_000_000.0), 2).alias("session_duration_min"),
    )


def events_per_session(events: DataFrame) -> DataFrame:
    """Events per session, largest first."""
    return (
        events.filter(F.col("session_id").isNotNull())
        .groupBy("session_id")
        .agg(F.count(F.lit(1)).alias("events_per_session"))
        .orderBy(F.desc("events_per_session"), "session_id")
    )


def session_explorer(
    sessions: DataFrame,
    spec: EventSpec,
    min_events: int = 3,
    only_converted: bool = False,
    only_success: bool = False,
    limit: int = 200,
) -> DataFrame:
    """The longest sessions with at least `min_events`, optionally only those that converted."""
    cart, order, success = spec.conversion_flags
    keep = F.col("num_events") >= min_events
    if only_converted:
        keep = keep & (F.col(cart) | F.col(order))
    if only_success:
        keep = keep & F.col(success)
    flags = list(dict.fromkeys((cart, order, success)))
    return (
        sessions.filter(keep)
        .orderBy(F.desc("num_events"), "session_id")
        .limit(limit)
        .select(
            "session_id",
            "profile_id",
            "num_events",
            "num_unique_links",
            "session_duration_min",
            "utm_source",
            "device_type",
            *flags,
        )
    )


Days = tuple[date, date]


def _timed_steps(events: DataFrame, spec: EventSpec, session_id: str | None, days: Days | None) -> DataFrame:
    if session_id is not None:
        events = events.filter(F.col("session_id") == session_id)
    if days is not None:
        events = events.filter(F.col("date_utc").between(*days))
    columns = ("id", "session_id", "create_ts", "name", "type", "page_url", "product_name")
    ordered = in_order(events.select(*columns), spec)
    steps = ordered.numbered("step").neighbour({"next_ts": "create_ts"}, 1).plain()
    return steps.withColumn("us", elapsed_us(F.col("create_ts"), F.col("next_ts")))


def session_timeline(
    events: DataFrame, spec: EventSpec, session_id: str | None = None, days: Days | None = None
) -> DataFrame:
    """The events of one session, or of every session in `events`, step by step.

    The filter on the session reaches the scan. `days`, the first and last UTC date of the session as
    its rollup has them, also leaves out the other dates of a table stored by date; events without a
    time are then left out. `duration_plot` is 0 where the time is not valid.
    """
    secs = seconds(F.col("us"))
    name = F.coalesce("name", F.lit(spec.null_name))
    return _timed_steps(events, spec, session_id, days).select(
        "session_id",
        "step",
        naive(F.col("create_ts")).alias("time"),
        F.col("name").alias("event"),
        "type",
        F.col("page_url").alias("url"),
        "product_name",
        duration_label(secs, spec.cap_seconds).alias("duration"),
        F.concat(F.col("step").cast("string"), F.lit(". "), name).alias("step_label"),
        F.when((secs > 0) & (secs <= spec.cap_seconds), secs)
        .otherwise(F.lit(0.0))
        .alias("duration_plot"),
    )


def session_timeline_totals(
    events: DataFrame, spec: EventSpec, session_id: str | None = None, days: Days | None = None
) -> DataFrame:
    """Per session: events, minutes from first to last, and seconds with each gap capped."""
    steps = _timed_steps(events, spec, session_id, days)
    capped = F.least(F.col("us"), F.lit(spec.cap_us))
    return (
        steps.groupBy("session_id")
        .agg(
            F.count(F.lit(1)).alias("events"),
            elapsed_us(F.min("create_ts"), F.max("create_ts")).alias("span"),
            # least() skips nulls, so the unmeasured last event must be left out explicitly
            F.coalesce(F.sum(F.when(F.col("us").isNotNull(), capped)), F.lit(0)).alias("us"),
        )
        .select(
            "session_id",
            "events",
            (F.col("span") / F.lit(60_000_000.0)).alias("total_min"),
            seconds(F.col("us")).alias("measured_sec"),
        )
    )


def kpis(sessions: DataFrame, spec: EventSpec) -> DataFrame:
    """Sessions, users, events and step sessions with rates, as one row."""
    flags = dict(zip(("cart", "order", "success"), spec.conversion_flags))
    totals = sessions.agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count_distinct("profile_id").alias("users"),
        F.coalesce(F.sum("num_events"), F.lit(0)).alias("events"),
        *(count_true(F.col(had)).alias(f"{role}_sessions") for role, had in flags.items()),
    )
    zero = F.lit(0.0)
    return totals.select(
        "*",
        F.coalesce(percent(F.col("cart_sessions"), F.col("sessions"), 2), zero).alias(
            "cart_rate_pct"
        ),
        F.coalesce(percent(F.col("order_sessions"), F.col("sessions"), 2), zero).alias(
            "order_rate_pct"
        ),
    )
