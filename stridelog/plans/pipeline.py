"""The batch runs: raw to clean events, clean events to aggregate tables, and the report.

Each run writes what later work reads, so a derived table is computed once and outlives the loss of
an executor, as files do.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import elapsed_us, naive, parsed_time, seconds
from ..functions.urls import canonical_link
from ..operators import breakdowns, cleaning, conversion, cubes, dwell, funnel, ordered_funnel, paths, profiling
from ..operators import sessions as session_views
from ..operators.ordering import in_order, measured, split_hot, time_order
from ..sources.generations import Generation, publish
from ..sources.readers import read_table
from ..sources.writers import Written, folder_bytes, write_bundle, write_table
from ..spec import EventSpec


def clean_events(
    raw: DataFrame,
    spec: EventSpec,
    keep: Iterable[str] = cleaning.KEEP_COLUMNS,
    pii: Iterable[str] = cleaning.PII_COLUMNS,
    repair: bool = True,
) -> DataFrame:
    """The kept columns without personal data, repaired, with create_ts, link, duration_sec and date_utc.

    The wide rows move once, into ranges of (date, session): the layout in which they are stored. The
    successor of a session's last event of a day comes from a narrow table of first times per day; it
    travels as a row of its own behind that event and is dropped after the ordering. Text is
    repaired after the move. With a spec that was `measured`, the rows of hot sessions go in ranges of
    (session, time, id) instead, so that no task holds a whole one.
    """
    kept = cleaning.drop_pii(cleaning.project_keep(raw, keep), pii)
    times = kept.select(
        kept[spec.columns["id"]].alias("id"),
        kept[spec.columns["session_id"]].alias("session_id"),
        parsed_time(kept, spec.columns["created"]).alias("create_ts"),
        F.struct(*(F.col(f"`{c}`") for c in kept.columns)).alias("kept"),
    ).withColumn("date_utc", F.to_date(naive(F.col("create_ts"))))
    large = None
    if spec.hot:
        times, hot = split_hot(times, spec.hot)
        large = in_order(hot, spec).neighbour({"next_ts": "create_ts"}, 1).plain()
    days = (
        times.filter(F.col("session_id").isNotNull() & F.col("date_utc").isNotNull())
        .groupBy("session_id", "date_utc")
        .agg(F.min("create_ts").alias("first_ts"))
    )
    next_day = F.lead("first_ts").over(Window.partitionBy("session_id").orderBy("date_utc"))
    markers = days.select(
        F.lit(None).cast(times.schema["id"].dataType).alias("id"),
        "session_id",
        next_day.alias("create_ts"),
        F.lit(None).cast(times.schema["kept"].dataType).alias("kept"),
        "date_utc",
    ).filter(F.col("create_ts").isNotNull())
    # Events without a session are spread; they have no successor.
    spread = F.when(F.col("session_id").isNull(), F.xxhash64("id"))
    keys = ("date_utc", "session_id", "_spread")
    moved = times.unionByName(markers).withColumn("_spread", spread).repartitionByRange(*keys)
    order = Window.partitionBy(*keys).orderBy(*time_order())
    next_ts = F.when(F.col("session_id").isNotNull(), F.lead("create_ts").over(order))
    timed = moved.withColumn("next_ts", next_ts).filter(F.col("kept").isNotNull()).drop("_spread")
    if large is not None:
        timed = timed.unionByName(large)
    clean = timed.select(
        "kept.*",
        F.col("create_ts"),
        seconds(elapsed_us(F.col("create_ts"), F.col("next_ts"))).alias("duration_sec"),
        "date_utc",
    )
    if repair:
        clean = cleaning.repair_text(clean, kept.columns)
    link = canonical_link(F.col(f"`{spec.columns['page_url']}`"))
    return clean.select(*(f"`{c}`" for c in kept.columns), "create_ts", link.alias("link"), "duration_sec", "date_utc")


def run_clean(
    raw: DataFrame,
    spec: EventSpec,
    folder: str,
    mode: str = "overwrite",
    clean_csv: bool = False,
    **options,
) -> dict[str, Written]:
    """Write the clean events by date, the event dwell table and the link dwell table by views.

    Returns rows and bytes of each. Files of clean events are sorted by session for the drill-down.
    The two dwell tables are computed from the written clean events. A rerun replaces the tables;
    `mode="error"` refuses to. `clean_csv` also writes the clean events as CSV.
    """
    spark, folder = raw.sparkSession, folder.rstrip("/")
    session = spec.columns["session_id"]
    # One narrow look at the raw table; text repair does not change which sessions are large.
    spec = measured(raw.select(raw[session].cast("string").alias("session_id")), spec)
    clean = clean_events(raw, spec, **options)
    done: dict[str, Written] = {}

    def save(name: str, df: DataFrame, fmt: str, **layout) -> None:
        rows = write_table(df, f"{folder}/{name}", fmt, mode=mode, **layout)
        done[name] = Written(rows, folder_bytes(spark, f"{folder}/{name}"))

    # The rows are in ranges of (date, session) already, those of hot sessions apart.
    save("events_clean", clean, "parquet", partition_by=["date_utc"], sort_by=[session], rebalance=bool(spec.hot))
    stored = read_table(spark, f"{folder}/events_clean")
    if clean_csv:
        save("events_clean_csv", stored, "csv")
    events = cleaning.canonical_events(stored, spec)
    save("event_duration", dwell.active_events(events, spec), "csv")
    by_views = dwell.link_dwell(events, spec).orderBy(F.desc("views"), "link")
    save("link_duration", by_views, "csv")
    return done


def run_aggregates(
    events: DataFrame, spec: EventSpec, folder: str, mode: str = "overwrite"
) -> dict[str, Written]:
    """Write the eleven aggregate tables, the cubes and the filter metadata of a canonical event table.

    The cubes hold sketches, which answer distinct counts and percentiles of any slice. Sessions, patterns and conversion pairs are read back for the tables built on them. Returns rows
    and bytes of each. A rerun replaces the tables; `mode="error"` refuses to.
    """
    spark, folder, spec = events.sparkSession, folder.rstrip("/"), measured(events, spec)
    done: dict[str, Written] = {}

    def save(name: str, df: DataFrame, fmt: str = "parquet") -> DataFrame:
        rows = write_table(df, f"{folder}/{name}", fmt, mode=mode)
        done[name] = Written(rows, folder_bytes(spark, f"{folder}/{name}"))
        return spark.read.schema(df.schema).format(fmt).load(f"{folder}/{name}")

    save("meta", profiling.filter_metadata(events), "json")
    save("filter_values", profiling.filter_values(events))
    sessions = save("sessions", session_views.session_rollup(events, spec))
    session_patterns = save("session_pattern", paths.session_pattern(events, spec))
    save("patterns", paths.patterns(session_patterns))
    save("funnel_rollup", funnel.funnel_rollup(sessions, spec))
    save("hourly", breakdowns.hourly_activity(events, spec))
    save("destinations", breakdowns.destinations(events, spec))
    save("utm_sources", breakdowns.utm_sources(sessions, spec))
    save("device", breakdowns.device_os(sessions, spec))
    pairs = save("product_conversion", conversion.product_conversion(events, sessions, spec))
    save("event_duration", dwell.event_dwell(events, spec))
    save("top_products", conversion.top_products(pairs))
    save("destination_cube", cubes.destination_cube(events, spec))
    save("visitor_cube", cubes.visitor_cube(sessions, spec))
    save("link_dwell_cube", cubes.dwell_cube(events, spec))
    save("event_dwell_cube", cubes.dwell_cube(events, spec, by="name"))
    save("funnel_grains", cubes.funnel_grains(sessions, spec))
    save("reach_in_order", ordered_funnel.reach_in_order(events, spec))
    return done


def publish_aggregates(events: DataFrame, spec: EventSpec, folder: str) -> Generation:
    """The tables of `run_aggregates` as a new generation: readers have the old set until all are there."""
    return publish(events.sparkSession, folder, lambda path: run_aggregates(events, spec, path, mode="error"))


def publish_report(tables: Mapping[str, DataFrame], folder: str) -> Generation:
    """The tables of a report as a new generation."""
    spark = next(iter(tables.values())).sparkSession

    def write(path: str) -> dict[str, Written]:
        rows = write_bundle(tables, path)
        return {name: Written(n, folder_bytes(spark, f"{path}/{name}")) for name, n in rows.items()}

    return publish(spark, folder, write)


def build_report(
    events: DataFrame, sessions: DataFrame, pairs: DataFrame, spec: EventSpec
) -> dict[str, DataFrame]:
    """The tables of the journey report by name, lazily; `write_bundle` stores them.

    `sessions` and `pairs` feed most of them: pass the written tables.
    """
    spec = measured(events, spec)
    session_patterns = paths.session_pattern(events, spec)
    return {
        "summary": profiling.summary(events, sessions, pairs, spec),
        "journey_per_session": paths.journeys(events, sessions, spec),
        "top_event_patterns": paths.patterns(session_patterns, 30),
        "funnel": funnel.funnel(events, spec),
        "product_view_per_user": pairs,
        "conv_by_views": conversion.conversion_by_views(pairs),
        "conv_by_time": conversion.conversion_by_time(pairs),
        "conv_views_x_time": conversion.conversion_matrix(pairs),
        "correlation": conversion.conversion_correlation(pairs),
        "top_destinations": breakdowns.top_destinations(events, spec),
        "utm_source_conv": breakdowns.utm_conversion(sessions, spec),
        "device": breakdowns.device_share(sessions, spec),
        "hour_of_day": breakdowns.hour_of_day(events, spec),
        "geo": breakdowns.geo(events),
    }


def duration_report(events: DataFrame, spec: EventSpec) -> dict[str, DataFrame]:
    """The three tables of the dwell study."""
    return {
        "per_event_duration": dwell.dwell_events(events, spec),
        "events_per_session": session_views.events_per_session(events),
        "summary": profiling.duration_study(events),
    }
