"""What is in a table: a dictionary of its columns, filter choices, and table-wide figures."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import count_true, percent, ratio
from ..functions.times import valid_dwell
from ..spec import EventSpec
from .dwell import not_homepage, with_dwell
from .statistics import percentiles

# Column groups of a web event table by name prefix, the longest prefix first.
PREFIX_MEANINGS = (
    ("context_page_ld_", "structured product data of the page"),
    ("context_page_", "page the event happened on"),
    ("context_", "client context"),
    ("request_headers_", "HTTP request header"),
    ("properties_contactInfo_", "contact data entered by the visitor"),
    ("properties_", "property of the event"),
    ("device_geo_", "place derived from the network address"),
    ("device_", "device"),
    ("metadata_", "collector bookkeeping"),
    ("session_", "session"),
    ("config_", "tracker configuration"),
    ("product_", "product"),
    ("geo_", "place"),
    ("page_", "page"),
    ("tags_", "tags of the event"),
    ("utm_", "campaign attribution"),
    ("app_", "browser or app"),
    ("hit_", "tracked hit"),
    ("os_", "operating system"),
)
UNKNOWN_MEANING = "(unknown)"


def described(column: str, meanings: Mapping[str, str]) -> str:
    """The given meaning of a column, or one made from its prefix and the rest of its name."""
    if column in meanings:
        return meanings[column]
    for prefix, group in PREFIX_MEANINGS:
        if column.startswith(prefix) and len(column) > len(prefix):
            return f"{group}: {column[len(prefix):].replace('_', ' ')}"
    return UNKNOWN_MEANING


def shortened(text: Column, size: int = 120) -> Column:
    return F.when(F.length(text) <= size, text).otherwise(
        F.concat(F.substring(text, 1, size - 3), F.lit("..."))
    )


def column_profile(
    df: DataFrame, meanings: Mapping[str, str] | None = None, exact: bool = True
) -> DataFrame:
    """(column, dtype, non_null, nunique, meaning, sample) with one row per column.

    Cells become (column, value) rows that are counted before the shuffle; exact distinct counts
    of any number of columns then take one pass and no group is held in memory. With `exact=False`
    distinct counts are estimates and nothing is shuffled but one row per task. The sample is the
    smallest value as text.
    """
    meanings = meanings or {}
    dictionary = df.sparkSession.createDataFrame(
        [
            (i, f.name, f.dataType.simpleString(), described(f.name, meanings))
            for i, f in enumerate(df.schema.fields)
        ],
        "position int, column string, dtype string, meaning string",
    )
    text = df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns))
    found = _exact_figures(text) if exact else _estimated_figures(text)
    return dictionary.join(found, "column", "left").select(
        "position",
        "column",
        "dtype",
        F.coalesce("non_null", F.lit(0)).alias("non_null"),
        F.coalesce("nunique", F.lit(0)).alias("nunique"),
        "meaning",
        F.coalesce(shortened(F.col("least")), F.lit("")).alias("sample"),
    )


def _exact_figures(text: DataFrame) -> DataFrame:
    cells = text.unpivot([], [F.col(f"`{c}`") for c in text.columns], "column", "value")
    return (
        cells.filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("column")
        .agg(
            F.sum("n").alias("non_null"),
            F.count(F.lit(1)).alias("nunique"),
            F.min("value").alias("least"),
        )
    )


def _estimated_figures(text: DataFrame) -> DataFrame:
    def figures(column: str) -> Column:
        value = F.col(f"`{column}`")
        return F.struct(
            F.lit(column).alias("column"),
            F.count(value).alias("non_null"),
            F.approx_count_distinct(value).alias("nunique"),
            F.min(value).alias("least"),
        )

    return text.agg(F.array(*map(figures, text.columns)).alias("rows")).selectExpr("inline(rows)")


# Filter dimension in the metadata -> event column.
FILTER_LISTS = {"utm_sources": "utm_source", "countries": "geo_country", "devices": "device_type"}


def filter_values(events: DataFrame) -> DataFrame:
    """(dimension, value): every choice of every filter."""
    return (
        events.select(*(F.col(c).alias(d) for d, c in FILTER_LISTS.items()))
        .unpivot([], list(FILTER_LISTS), "dimension", "value")
        .filter(F.col("value").isNotNull())
        .distinct()
    )


def filter_metadata(events: DataFrame) -> DataFrame:
    """One row: all filter choices sorted, first and last local date, and totals.

    The lists hold distinct values, found before they come together; `filter_values` has them as rows.
    """
    choices = filter_values(events).agg(
        F.struct(
            *(
                F.array_sort(F.collect_list(F.when(F.col("dimension") == d, F.col("value")))).alias(d)
                for d in FILTER_LISTS
            )
        ).alias("lists")
    )
    totals = events.agg(
        F.min("date_local").alias("date_min"),
        F.max("date_local").alias("date_max"),
        F.count(F.lit(1)).alias("total_events"),
        F.count_distinct("session_id").alias("total_sessions"),
        F.count_distinct("profile_id").alias("total_profiles"),
    )
    return totals.withColumn("_lists", choices.scalar()).select(
        *(F.col("_lists")[d].alias(d) for d in FILTER_LISTS),
        "date_min",
        "date_max",
        "total_events",
        "total_sessions",
        "total_profiles",
    )


def as_metrics(one_row: DataFrame) -> DataFrame:
    """A one-row table as (metric, value) rows, values as doubles."""
    return one_row.select(*(F.col(c).cast("double").alias(c) for c in one_row.columns)).unpivot(
        [], one_row.columns, "metric", "value"
    )


def duration_study(events: DataFrame) -> DataFrame:
    """Whether the time columns can carry a dwell study: ten (metric, value) rows."""
    return as_metrics(
        events.agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_distinct("session_id").alias("unique_session_id"),
            F.count_distinct("profile_id").alias("unique_profile_id"),
            F.count_distinct("link").alias("unique_link"),
            F.min("session_duration").alias("session_duration_min"),
            F.max("session_duration").alias("session_duration_max"),
            F.avg("session_duration").alias("session_duration_mean"),
            F.count("create_ts").alias("has_create_ts"),
            F.count("insert_ts").alias("has_insert_ts"),
            F.count("session_start_ts").alias("has_session_start"),
        )
    )


def _session_sizes(events: DataFrame) -> DataFrame:
    return (
        events.filter(F.col("session_id").isNotNull())
        .groupBy("session_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def median_of(df: DataFrame, value: str) -> Column:
    """The exact median of whole numbers as a scalar, found by value ranges over many tasks."""
    sized = df.select(F.lit(0).alias("_all"), F.col(value).alias("_value"))
    return percentiles(sized, ["_all"], "_value", {"median": 0.5}).select("median").scalar()


def session_size_figures(events: DataFrame) -> DataFrame:
    """One row on events per session."""
    sizes = _session_sizes(events)
    return sizes.agg(
        F.round(F.avg("n"), 2).alias("events_per_session_mean"),
        median_of(sizes, "n").alias("events_per_session_median"),
        F.max("n").alias("events_per_session_max"),
        count_true(F.col("n") == 1).alias("sessions_with_1_event"),
        percent(count_true(F.col("n") == 1), F.count(F.lit(1)), 1).alias(
            "sessions_with_1_event_pct"
        ),
    )


def pipeline_summary(events: DataFrame, spec: EventSpec) -> DataFrame:
    """Figures on a processed event table as (metric, value) rows."""
    timed = with_dwell(events, spec, ["link"])
    active = valid_dwell(F.col("dwell_us"), spec.cap_us).isNotNull() & not_homepage(spec)
    n = F.count(F.lit(1))
    totals = timed.agg(
        n.alias("total_events"),
        F.count("dwell_us").alias("computable"),
        percent(F.count("dwell_us"), n, 1).alias("computable_pct"),
        count_true(active).alias("active_events"),
    )
    distinct = events.agg(
        F.count_distinct("session_id").alias("unique_sessions"),
        F.count_distinct("profile_id").alias("unique_profiles"),
        F.count_distinct("link").alias("unique_links"),
    )
    figures = [as_metrics(t) for t in (totals, distinct, session_size_figures(events))]
    return figures[0].unionByName(figures[1]).unionByName(figures[2])


def summary(events: DataFrame, sessions: DataFrame, pairs: DataFrame, spec: EventSpec) -> DataFrame:
    """The report's headline figures as (metric, value) rows."""
    n = F.count(F.lit(1))
    of_events = events.agg(
        n.alias("total_events"),
        F.count_distinct("session_id").alias("unique_sessions"),
        F.count_distinct("profile_id").alias("unique_profiles"),
    )
    roles = {
        "search": spec.search_key,
        "cart": spec.cart_key,
        "order": spec.order_key,
        "success": spec.success_key,
    }
    had = {role: count_true(F.col(spec.step(key).had)) for role, key in roles.items()}
    minutes = F.sum(F.round(F.col("session_duration_min") * 100).cast("long"))
    of_sessions = sessions.agg(
        *(count.alias(f"sessions_with_{role}") for role, count in had.items()),
        percent(had["cart"], n, 3).alias("cart_rate_pct"),
        percent(had["order"], n, 3).alias("order_rate_pct"),
        F.round(ratio(F.sum("num_events"), n), 2).alias("avg_events_per_session"),
        F.floor(median_of(sessions, "num_events")).alias("median_events_per_session"),
        F.round(ratio(minutes, F.count("session_duration_min")) / 100, 2).alias(
            "avg_session_minutes"
        ),
    )
    intents, bookings = count_true(F.col("intent")), count_true(F.col("booked"))
    of_pairs = pairs.agg(
        n.alias("viewed_pairs"),
        intents.alias("pairs_with_intent"),
        bookings.alias("pairs_booked"),
        percent(intents, n, 3).alias("intent_rate_pct"),
        percent(bookings, n, 3).alias("booking_rate_pct"),
    )
    return (
        as_metrics(of_events).unionByName(as_metrics(of_sessions)).unionByName(as_metrics(of_pairs))
    )
