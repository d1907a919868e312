"""The named queries: every operator on the click table derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import CP1252_BYTES, CP1252_CHARS
from ..functions.times import local_date, local_hour, naive, parsed_time
from ..functions.urls import canonical_link, first_group
from ..operators import breakdowns, cleaning, conversion, cubes, dwell, funnel, ordered_funnel, paths, profiling
from ..operators import sessions as session_views
from ..operators.ordering import measured
from ..session import configure, fresh_path
from ..sources import generations, quarantine
from ..sources.demo import CLICKS_PII, CLICKS_SPEC, clicks, clicks_of
from ..sources.readers import read_table
from ..sources.writers import write_table
from ..spec import EventSpec, FilterSpec
from ..streaming import rollups
from . import pipeline, refresh
from .router import Router

SPEC = CLICKS_SPEC
SLICE = FilterSpec(device="mobile", date_from=date(2024, 1, 5), date_to=date(2024, 1, 20))
REGION = FilterSpec(source="src1", country="US", date_from=date(2024, 1, 3), date_to=date(2024, 1, 25))
KEPT = ("id", "session_id", "name", "page_url", "utm_source", "utm_term", "contact_email")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def raw(spark: SparkSession, folder: str) -> DataFrame:
    return clicks(configure(spark), folder)


def events(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.canonical_events(raw(spark, folder), SPEC)


#: The spec with the hot sessions of a folder, by application and folder.
_MEASURED: dict[tuple[str, str], EventSpec] = {}


def spec_of(spark: SparkSession, folder: str) -> EventSpec:
    """The spec with the sessions that are too large for one task, looked up once per table."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _MEASURED:
        _MEASURED[key] = measured(events(spark, folder), SPEC)
    return _MEASURED[key]


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    return session_views.session_rollup(events(spark, folder), spec_of(spark, folder))


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    found, spec = events(spark, folder), spec_of(spark, folder)
    return conversion.product_conversion(found, session_views.session_rollup(found, spec), spec)


def session_patterns(spark: SparkSession, folder: str) -> DataFrame:
    return paths.session_pattern(events(spark, folder), spec_of(spark, folder))


# ---- one slice by source, country and dates over every view ------------------------------------


@query
def slice_kpis(spark, folder):
    return session_views.kpis(REGION.apply(sessions(spark, folder)), SPEC)


@query
def slice_funnel(spark, folder):
    return funnel.funnel_of_sessions(REGION.apply(sessions(spark, folder)), SPEC)


@query
def slice_patterns(spark, folder):
    found = events(spark, folder)
    chosen = REGION.apply(session_views.session_rollup(found, spec_of(spark, folder)))
    return paths.patterns(paths.patterns_of(paths.session_pattern(found, spec_of(spark, folder)), chosen))


@query
def slice_explorer(spark, folder):
    rolled = REGION.apply(sessions(spark, folder))
    return session_views.session_explorer(rolled, SPEC, 2, only_success=True)


@query
def slice_conversion(spark, folder):
    chosen = conversion.filter_conversion(pairs(spark, folder), REGION.without("date"))
    return conversion.conversion_by_views(chosen)


@query
def slice_destinations(spark, folder):
    return breakdowns.top_destinations(events(spark, folder), SPEC, REGION)


@query
def slice_sources(spark, folder):
    table = breakdowns.utm_sources(sessions(spark, folder), SPEC)
    return breakdowns.utm_performance(table, SPEC, FilterSpec(device="mobile"))


@query
def slice_daily_trend(spark, folder):
    cube = funnel.funnel_rollup(sessions(spark, folder), SPEC, date_column="date_local")
    return funnel.daily_trend(cube, SPEC, REGION)


# ---- options of operators -----------------------------------------------------------------------


@query
def hour_of_day_views_only(spark, folder):
    return breakdowns.hour_of_day(events(spark, folder), SPEC, views_only=True)


@query
def active_events_everywhere(spark, folder):
    return dwell.active_events(events(spark, folder), spec_of(spark, folder), exclude_home=False)


@query
def link_dwell_null_link(spark, folder):
    spec = replace(spec_of(spark, folder), null_link="(none)")
    table = dwell.link_dwell(cleaning.canonical_events(raw(spark, folder), spec), spec)
    return table.select("link", "views", "unique_sessions", "unique_users")


@query
def product_conversion_ordered(spark, folder):
    found = events(spark, folder)
    rolled = session_views.session_rollup(found, spec_of(spark, folder))
    return conversion.product_conversion(found, rolled, spec_of(spark, folder), ordered_intent=True).select(
        "profile_id", "product_id", "views", "intent", "booked"
    )


@query
def lookup_sql(spark, folder):
    """The drill-down as SQL with a bound parameter over a view on stored Parquet."""
    path = fresh_path(spark, "lookup-sessions")
    write_table(sessions(spark, folder), path)
    read_table(spark, path).createOrReplaceTempView("stride_stored_sessions")
    return spark.sql(
        "SELECT session_id, num_events, device_type, started_at FROM stride_stored_sessions "
        "WHERE profile_id = :profile AND num_events >= :least",
        args={"profile": "u1", "least": 1},
    )


# ---- sources and sinks --------------------------------------------------------------------------


@query
def src_parquet(spark, folder):
    table = read_table(configure(spark), f"{folder}/events.parquet")
    return table.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_ts")
    )


@query
def src_csv_roundtrip(spark, folder):
    table = raw(spark, folder).select("id", "session_id", "name", "page_url", "create_text")
    path = fresh_path(spark, "events-csv")
    write_table(table, path, "csv")
    return read_table(spark, path, "csv", table.schema)


@query
def src_glob_union(spark, folder):
    table = raw(spark, folder).select("id", "name", "create_ts_raw")
    table = table.withColumn("day", F.date_format("create_ts_raw", "yyyyMMdd")).drop("create_ts_raw")
    path = fresh_path(spark, "events-by-day")
    write_table(table, path, partition_by=["day"])
    union = read_table(spark, f"{path}/day=*", merge_schema=True, base_path=path)
    return union.groupBy("day").agg(
        F.count(F.lit(1)).alias("events"), F.count("name").alias("named")
    )


@query
def sql_smoke(spark, folder):
    sessions(spark, folder).createOrReplaceTempView("stride_sessions")
    pairs(spark, folder).createOrReplaceTempView("stride_pairs")
    return spark.sql("""
        SELECT 'sessions' AS source, count(*) AS n, sum(cast(had_signup AS int)) AS hits
        FROM stride_sessions
        UNION ALL
        SELECT 'pairs', count(*), sum(cast(intent AS int)) FROM stride_pairs
    """)


@query
def filter_metadata(spark, folder):
    one = profiling.filter_metadata(events(spark, folder))
    lists = {c: F.array_join(c, ",") for c in profiling.FILTER_LISTS}
    return one.withColumns(lists)


@query
def filter_values(spark, folder):
    return profiling.filter_values(events(spark, folder))


# ---- cleaning and derived columns ---------------------------------------------------------------


@query
def project_keep(spark, folder):
    return cleaning.project_keep(raw(spark, folder), KEPT)


@query
def drop_pii(spark, folder):
    kept = cleaning.drop_pii(cleaning.project_keep(raw(spark, folder), KEPT), CLICKS_PII)
    return kept.select(*kept.columns, F.lit(",".join(kept.columns)).alias("kept_columns"))


@query
def repair_text(spark, folder):
    documents = configure(spark).read.parquet(f"{folder}/documents.parquet")
    garbled = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return cleaning.repair_text(documents.select("doc_id", garbled.alias("text")))


@query
def repair_deep_text(spark, folder):
    """Texts garbled twice, through Windows-1252, or with escaped code points, by their number."""
    documents = configure(spark).read.parquet(f"{folder}/documents.parquet")

    def misread(text):
        return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")

    once = misread(F.col("text"))
    kind = F.col("doc_id") % 3
    garbled = (
        F.when(kind == 0, misread(once))
        .when(kind == 1, F.translate(once, CP1252_BYTES, CP1252_CHARS))
        .otherwise(F.replace(once, F.lit("\u00c3"), F.lit("_x00C3_")))
    )
    return cleaning.repair_text(documents.select("doc_id", garbled.alias("text")))


@query
def repair_clean_text(spark, folder):
    documents = configure(spark).read.parquet(f"{folder}/documents.parquet")
    return cleaning.repair_text(documents.select("doc_id", "text", "lang"), ["text"])


@query
def parse_ts(spark, folder):
    table = raw(spark, folder)
    ts = parsed_time(table, "create_text")
    return table.select("id", "create_text", naive(ts).alias("ts"), ts.isNotNull().alias("parsed"))


@query
def canonical_links(spark, folder):
    pages = configure(spark).read.parquet(f"{folder}/pages.parquet")
    return pages.select(
        "page_id",
        canonical_link(F.col("url")).alias("link"),
        canonical_link(F.col("url"), strip_query=True).alias("bare_link"),
    )


@query
def url_extract(spark, folder):
    url = F.col("page_url")
    return raw(spark, folder).select(
        "id",
        first_group(url, SPEC.product_pattern).alias("product_id"),
        first_group(url, SPEC.destination_pattern).alias("destination"),
    )


@query
def local_time(spark, folder):
    table = raw(spark, folder)
    ts = parsed_time(table, "create_ts_raw")
    return table.select(
        "id",
        local_hour(ts, SPEC.utc_offset_hours).alias("hour_local"),
        local_date(ts, SPEC.utc_offset_hours).alias("date_local"),
    )


@query
def column_profile(spark, folder):
    told = {"id": "number of the event", "name": "what happened"}
    return profiling.column_profile(raw(spark, folder).drop("create_ts_raw"), told)


# ---- dwell --------------------------------------------------------------------------------------


@query
def dwell_events(spark, folder):
    return dwell.dwell_events(events(spark, folder), spec_of(spark, folder))


@query
def active_events(spark, folder):
    return dwell.active_events(events(spark, folder), spec_of(spark, folder))


@query
def link_dwell(spark, folder):
    table = dwell.link_dwell(events(spark, folder), spec_of(spark, folder))
    times = [c for c in table.columns if c.endswith("_sec")]
    return table.withColumns({c: F.round(c, 3) for c in times})


@query
def event_dwell(spark, folder):
    return dwell.event_dwell(events(spark, folder), spec_of(spark, folder))


@query
def duration_study(spark, folder):
    study = profiling.duration_study(events(spark, folder))
    return study.withColumn("value", F.round("value", 3))


@query
def pipeline_summary(spark, folder):
    return profiling.pipeline_summary(events(spark, folder), spec_of(spark, folder))


# ---- sessions -----------------------------------------------------------------------------------


@query
def session_rollup(spark, folder):
    return sessions(spark, folder)


@query
def events_per_session(spark, folder):
    return session_views.events_per_session(events(spark, folder))


@query
def session_explorer(spark, folder):
    return session_views.session_explorer(sessions(spark, folder), SPEC, 3, only_converted=True)


@query
def session_timeline(spark, folder):
    return session_views.session_timeline(events(spark, folder), spec_of(spark, folder))


@query
def session_timeline_totals(spark, folder):
    return session_views.session_timeline_totals(events(spark, folder), spec_of(spark, folder))


@query
def session_lookup(spark, folder):
    """The drill-down: the session that the explorer lists first, step by step."""
    found = events(spark, folder)
    explored = session_views.session_explorer(
        session_views.session_rollup(found, spec_of(spark, folder)), SPEC, min_events=1, limit=1
    )
    chosen = F.broadcast(explored.select("session_id"))  # one row
    return session_views.session_timeline(found.join(chosen, "session_id", "left_semi"), spec_of(spark, folder))


@query
def kpi_filtered(spark, folder):
    return session_views.kpis(SLICE.apply(sessions(spark, folder)), SPEC)


# ---- paths --------------------------------------------------------------------------------------


@query
def event_sequence(spark, folder):
    return paths.event_sequence(events(spark, folder), spec_of(spark, folder))


@query
def link_sequence(spark, folder):
    return paths.link_sequence(events(spark, folder), spec_of(spark, folder))


@query
def journeys(spark, folder):
    found = events(spark, folder)
    spec = spec_of(spark, folder)
    return paths.journeys(found, session_views.session_rollup(found, spec), spec)


@query
def session_pattern(spark, folder):
    return session_patterns(spark, folder)


@query
def patterns(spark, folder):
    return paths.patterns(session_patterns(spark, folder))


@query
def pattern_search(spark, folder):
    ranked = paths.ranked_patterns(session_patterns(spark, folder))
    return paths.pattern_search(ranked, "SIGNUP > (view|click)")


@query
def pattern_search_totals(spark, folder):
    counts = paths.pattern_counts(session_patterns(spark, folder))
    return paths.search_totals(paths.pattern_search(counts, "purchase"))


@query
def patterns_filtered(spark, folder):
    found = events(spark, folder)
    spec = spec_of(spark, folder)
    chosen = SLICE.apply(session_views.session_rollup(found, spec))
    return paths.patterns(paths.patterns_of(paths.session_pattern(found, spec), chosen))


# ---- funnels ------------------------------------------------------------------------------------


@query
def funnel_steps(spark, folder):
    return funnel.funnel(events(spark, folder), SPEC)


@query
def funnel_filtered(spark, folder):
    return funnel.funnel_of_sessions(SLICE.apply(sessions(spark, folder)), SPEC)


@query
def funnel_by_device(spark, folder):
    return funnel.funnel_by_device(sessions(spark, folder), SPEC)


@query
def funnel_rollup(spark, folder):
    return funnel.funnel_rollup(sessions(spark, folder), SPEC)


@query
def daily_trend(spark, folder):
    return funnel.daily_trend(funnel.funnel_rollup(sessions(spark, folder), SPEC), SPEC)


# ---- conversion ---------------------------------------------------------------------------------


@query
def product_conversion(spark, folder):
    return pairs(spark, folder)


@query
def conv_by_views(spark, folder):
    return conversion.conversion_by_views(pairs(spark, folder))


@query
def conv_by_time(spark, folder):
    return conversion.conversion_by_time(pairs(spark, folder))


@query
def conv_filtered(spark, folder):
    chosen = conversion.filter_conversion(pairs(spark, folder), SLICE.without("date"))
    return conversion.conversion_by_views(chosen)


@query
def conv_cross(spark, folder):
    return conversion.conversion_cross(pairs(spark, folder))


@query
def conv_matrix(spark, folder):
    return conversion.conversion_matrix(pairs(spark, folder))


@query
def conv_matrix_users(spark, folder):
    return conversion.conversion_matrix(pairs(spark, folder), "users")


@query
def correlation(spark, folder):
    return conversion.conversion_correlation(pairs(spark, folder))


@query
def top_products(spark, folder):
    return conversion.top_products(pairs(spark, folder))


@query
def top_products_by_name(spark, folder):
    return conversion.top_products(pairs(spark, folder), by_name=True)


# ---- breakdowns ---------------------------------------------------------------------------------


@query
def hourly_activity(spark, folder):
    return breakdowns.hourly_activity(events(spark, folder), SPEC)


@query
def hour_of_day(spark, folder):
    return breakdowns.hour_of_day(events(spark, folder), SPEC)


@query
def hour_of_day_rate(spark, folder):
    return breakdowns.hour_of_day_rate(
        breakdowns.hourly_activity(events(spark, folder), SPEC), SLICE.without("device")
    )


@query
def destinations(spark, folder):
    return breakdowns.destinations(events(spark, folder), SPEC)


@query
def top_destinations(spark, folder):
    return breakdowns.top_destinations(events(spark, folder), SPEC)


@query
def top_destinations_summed(spark, folder):
    return breakdowns.top_destinations_summed(
        breakdowns.destinations(events(spark, folder), SPEC), SLICE.without("date")
    )


@query
def geo(spark, folder):
    return breakdowns.geo(events(spark, folder))


@query
def utm_sources(spark, folder):
    return breakdowns.utm_sources(sessions(spark, folder), SPEC)


@query
def utm_conversion(spark, folder):
    return breakdowns.utm_conversion(sessions(spark, folder), SPEC)


@query
def utm_performance(spark, folder):
    return breakdowns.utm_performance(
        breakdowns.utm_sources(sessions(spark, folder), SPEC), SPEC
    )


@query
def device_os(spark, folder):
    return breakdowns.device_os(sessions(spark, folder), SPEC)


@query
def device_share(spark, folder):
    return breakdowns.device_share(sessions(spark, folder), SPEC)


@query
def device_share_unweighted(spark, folder):
    return breakdowns.device_share_unweighted(
        breakdowns.device_os(sessions(spark, folder), SPEC)
    )


@query
def os_breakdown(spark, folder):
    return breakdowns.os_breakdown(sessions(spark, folder), SPEC)


@query
def summary(spark, folder):
    found = events(spark, folder)
    spec = spec_of(spark, folder)
    rolled = session_views.session_rollup(found, spec)
    return profiling.summary(
        found, rolled, conversion.product_conversion(found, rolled, spec), spec
    )


# The inventory's names for two queries whose functions would hide a module or an import.
QUERIES["funnel"] = QUERIES.pop("funnel_steps")
QUERIES["canonical_link"] = QUERIES.pop("canonical_links")


# ---- stored cubes with sketches, grains, ordered steps ------------------------------------------


def _near(estimate: str, exact: str, percent: int = 2):
    """Whether the estimate is off by that many percent at most."""
    return F.abs(F.col(estimate) - F.col(exact)) * 100 <= F.col(exact) * percent


@query
def destination_sketches(spark, folder):
    """A slice answered by the stored cube beside the exact counts over the events."""
    found = events(spark, folder)
    path = fresh_path(spark, "destination-cube")
    write_table(cubes.destination_cube(found, SPEC), path)
    near = cubes.destinations_of(read_table(spark, path), REGION).withColumnsRenamed({"unique_sessions": "s", "unique_users": "u"})
    exact = breakdowns.top_destinations(found, SPEC, REGION)
    return exact.join(near.drop("views"), "destination").select(
        "destination", "views", "unique_sessions", "unique_users", _near("s", "unique_sessions").alias("sessions_near"), _near("u", "unique_users").alias("users_near")
    )


@query
def visitor_sketches(spark, folder):
    """Sessions and users per step of a slice by the stored cube; users beside their exact count."""
    found = sessions(spark, folder)
    path = fresh_path(spark, "visitor-cube")
    write_table(cubes.visitor_cube(found, SPEC), path)
    near = cubes.visitors_of(read_table(spark, path), SPEC, SLICE).withColumnRenamed("users", "near")
    chosen = SLICE.apply(found)
    users = [F.count_distinct("profile_id").alias("all"), *(F.count_distinct(F.when(F.col(s.had), F.col("profile_id"))).alias(s.name) for s in SPEC.steps)]
    exact = chosen.agg(*users).unpivot([], ["all", *(s.name for s in SPEC.steps)], "step", "users")
    return near.join(exact, "step").select("step_order", "step", "sessions", "users", _near("near", "users").alias("users_near"))


@query
def link_dwell_sketches(spark, folder):
    """Dwell statistics of a slice by the stored cube, with a check of the percentiles' ranks among the measured times."""
    found = events(spark, folder)
    path = fresh_path(spark, "dwell-cube")
    write_table(cubes.dwell_cube(found, spec_of(spark, folder)), path)
    near = cubes.dwell_of(read_table(spark, path), "link", REGION)
    timed = dwell.valid_events(found, spec_of(spark, folder), ("link", "date_local", *cubes.SLICES))
    timed = REGION.apply(timed, date_column="date_local").withColumn("sec", F.col("dwell_us") / F.lit(1_000_000.0))

    def rank(column: str, fraction: float):
        below, upto = (F.avg(c.cast("double")) for c in (F.col("sec") < F.col(column), F.col("sec") <= F.col(column)))
        return (below <= fraction + 0.02) & (upto >= fraction - 0.02)

    ranked = timed.join(near, "link").groupBy("link").agg(rank("median_time_sec", 0.5).alias("median_near"), rank("p90_time_sec", 0.9).alias("p90_near"))
    return near.join(ranked, "link").select("link", "views", F.round("total_time_sec", 6).alias("total_time_sec"), "median_near", "p90_near")


@query
def event_dwell_sketches(spark, folder):
    """All measured events per name from the cube of names."""
    near = cubes.dwell_of(cubes.dwell_cube(events(spark, folder), spec_of(spark, folder), by="name"), "name")
    return near.select("name", "views", F.round("total_time_sec", 6).alias("total_time_sec"), F.round("avg_time_sec", 6).alias("avg_time_sec"))


@query
def funnel_grains(spark, folder):
    return cubes.funnel_grains(sessions(spark, folder), SPEC)


@query
def funnel_in_order(spark, folder):
    return ordered_funnel.ordered_funnel(events(spark, folder), spec_of(spark, folder))


@query
def funnel_in_order_within(spark, folder):
    """Chains of at most two hours."""
    return ordered_funnel.ordered_funnel(events(spark, folder), spec_of(spark, folder), 7200)


@query
def reach_in_order(spark, folder):
    """When each session reaches each step within a day, by one session per row."""
    return ordered_funnel.reach_in_order(events(spark, folder), spec_of(spark, folder), 86_400)


# ---- tables kept up to date, published, looked up; intake ---------------------------------------


@query
def refreshed_sessions(spark, folder):
    """Sessions after the tables of 7 in 10 events were refreshed with the others."""
    table = raw(spark, folder).drop("create_ts_raw")
    path, options = fresh_path(spark, "refreshed"), {"keep": table.columns, "pii": CLICKS_PII, "repair": False}
    late = F.pmod(F.xxhash64("id"), F.lit(10)) >= 7
    refresh.build(table.filter(~late), SPEC, path, **options)
    refresh.refresh(table.filter(late), SPEC, path, **options)
    return read_table(spark, f"{path}/sessions").drop("bucket").select(*sessions(spark, folder).columns)


@query
def session_index(spark, folder):
    """The drill-down by the index: the session that the explorer lists first."""
    found, path = events(spark, folder), fresh_path(spark, "session-index")
    refresh.SessionIndex.write(found, SPEC, path)
    first = session_views.session_explorer(sessions(spark, folder), SPEC, min_events=1, limit=1).first()["session_id"]
    return refresh.SessionIndex(spark, path, SPEC).timeline(first)


@query
def published_funnel(spark, folder):
    """The funnel as readers of the newest generation see it."""
    path = fresh_path(spark, "published")
    pipeline.publish_report({"funnel": funnel.funnel(events(spark, folder), SPEC)}, path)
    return generations.current(spark, path).table(spark, "funnel")


@query
def routed_slice(spark, folder):
    """Sessions per step and device of a slice, from the smallest table that has them."""
    path, found = fresh_path(spark, "routed"), sessions(spark, folder)
    pipeline.publish_report({"sessions": found, "funnel_rollup": funnel.funnel_rollup(found, SPEC), "funnel_grains": cubes.funnel_grains(found, SPEC)}, path)
    router = Router(spark, generations.current(spark, path), SPEC)
    return router.answer(["sessions", *(s.reached for s in SPEC.steps)], REGION, ["device_type"])


@query
def quarantine_counts(spark, folder):
    return quarantine.counts(quarantine.split(raw(spark, folder), SPEC)[1])


def _streamed(spark, folder, make):
    """Closed windows of the events read as a stream, from Parquet."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    # A pattern, as a stream takes a single file for a folder otherwise.
    stream = spark.readStream.schema(schema).parquet(f"{folder}/event[s].parquet")
    path = fresh_path(spark, "streamed")
    rows = make(clicks_of(configure(spark), stream), SPEC)
    rollups.append_to(rows, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return read_table(spark, f"{path}/rows", schema=rows.schema)


@query
def streamed_hours(spark, folder):
    return _streamed(spark, folder, rollups.hourly_windows)


@query
def streamed_sessions(spark, folder):
    return _streamed(spark, folder, rollups.session_windows)
