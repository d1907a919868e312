"""Ordered event and link sequences per session, collapsed paths, and how common they are.

A sequence is one text per session, whatever its length. It is put together in two levels, runs of
`RUN` events first, so a task holds one run of events and otherwise only finished texts. A text too
large for a row fails the job; it is never shortened.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rates import percent
from ..session import written
from ..spec import EventSpec
from .ordering import Ordered, in_order


def collapse_repeats(items: Column) -> Column:
    """An array without the elements that equal the one before them."""
    return F.filter(
        items, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(items, i - F.lit(1)))
    )


#: Events joined at a time.
RUN = 1000


def _joined(numbered: DataFrame, spec: EventSpec, texts: Mapping[str, str]) -> DataFrame:
    """One row per session, with each of `texts` (output -> column) joined in order.

    Nulls are skipped; `<output>_items` counts the others.
    """
    columns = list(dict.fromkeys(texts.values()))
    events = F.array_sort(F.collect_list(F.struct("position", *columns))).alias("_events")
    counts = [F.count(column).alias(f"_{out}_n") for out, column in texts.items()]

    def text(rows: str, field: str) -> Column:
        return F.array_join(F.transform(rows, lambda row: row[field]), spec.separator)

    runs = (
        numbered.withColumn("_run", F.floor((F.col("position") - 1) / RUN).cast("long"))
        .groupBy("session_id", "_run")
        .agg(events, *counts)
        .select(
            "session_id",
            "_run",
            # null, and so skipped, for a run without any text
            *(F.when(F.col(f"_{out}_n") > 0, text("_events", c)).alias(out) for out, c in texts.items()),
            *(f"_{out}_n" for out in texts),
        )
    )
    return (
        runs.groupBy("session_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("_run", *texts))).alias("_runs"),
            *(F.sum(f"_{out}_n").alias(f"{out}_items") for out in texts),
        )
        .select(
            "session_id",
            *(text("_runs", out).alias(out) for out in texts),
            *(f"{out}_items" for out in texts),
        )
    )


def sequences(events: DataFrame, spec: EventSpec, texts: Mapping[str, str]) -> DataFrame:
    """Columns of the events of each session, joined in event order."""
    columns = dict.fromkeys(("id", "session_id", "create_ts", *texts.values()))
    ordered = in_order(events.select(*columns), spec).numbered("position")
    return _joined(ordered.plain(), spec, texts)


def event_sequence(events: DataFrame, spec: EventSpec) -> DataFrame:
    """The event names of each session in order; a null name is spelled out."""
    named = events.withColumn("step_name", _step_name(spec))
    return sequences(named, spec, {"event_sequence": "step_name"}).withColumnRenamed(
        "event_sequence_items", "items"
    )


def link_sequence(events: DataFrame, spec: EventSpec) -> DataFrame:
    """The non-null links of each session in order; empty for a session without any."""
    return sequences(events, spec, {"link_sequence": "link"}).withColumnRenamed(
        "link_sequence_items", "items"
    )


def journeys(events: DataFrame, sessions: DataFrame, spec: EventSpec) -> DataFrame:
    """The session rollup with both sequences, which come from one ordering of the events."""
    texts = {"event_sequence": "step_name", "link_sequence": "link"}
    found = sequences(events.withColumn("step_name", _step_name(spec)), spec, texts)
    return sessions.join(
        found.select("session_id", "event_sequence", "link_sequence"), "session_id"
    )


def _step_name(spec: EventSpec) -> Column:
    return F.coalesce("name", F.lit(spec.null_name))


def collapsed_steps(events: DataFrame, spec: EventSpec) -> Ordered:
    """The events that differ in name from the one before them, numbered within the session."""
    columns = events.select("id", "session_id", "create_ts", _step_name(spec).alias("step_name"))
    ordered = in_order(columns, spec).neighbour({"previous": "step_name"}, -1)
    changed = ~F.col("step_name").eqNullSafe(F.col("previous"))
    return ordered.where(changed).numbered("position")


def session_pattern(events: DataFrame, spec: EventSpec) -> DataFrame:
    """(session_id, pattern, steps): the whole path of each session with repeats collapsed."""
    steps = collapsed_steps(events, spec).plain()
    return _joined(steps, spec, {"pattern": "step_name"}).withColumnRenamed("pattern_items", "steps")


def pattern_counts(session_patterns: DataFrame) -> DataFrame:
    """(pattern, sessions, share_pct) of all patterns, unranked."""
    counts = session_patterns.groupBy("pattern").agg(F.count(F.lit(1)).alias("sessions"))
    total = counts.agg(F.sum("sessions").alias("total")).scalar()  # reuses the same shuffle
    return counts.withColumn("share_pct", percent(F.col("sessions"), total, 2))


def pattern_order() -> tuple[Column, Column]:
    return F.desc("sessions"), F.asc("pattern")


def patterns(session_patterns: DataFrame, limit: int = 1000) -> DataFrame:
    """The most common patterns with their rank."""
    top = pattern_counts(session_patterns).orderBy(*pattern_order()).limit(limit)
    rank = F.row_number().over(Window.orderBy(*pattern_order())).cast("long")
    return top.select(rank.alias("rank"), "pattern", "sessions", "share_pct")


def ranked_patterns(session_patterns: DataFrame) -> DataFrame:
    """All patterns with their rank, however many there are.

    The counts are written in range partitions of the ranking order, and each is ranked on its own
    from the number of patterns before it.
    """
    ranges = written(
        pattern_counts(session_patterns)
        .repartitionByRange(*pattern_order())
        .withColumn("_range", F.spark_partition_id()),
        "patterns",
    )
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: as many as the range partitioning makes.
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*pattern_order()))
    return (
        ranges.withColumn("_within", within)
        .join(F.broadcast(offsets), "_range")
        .select(
            (F.col("_base") + F.col("_within")).alias("rank"), "pattern", "sessions", "share_pct"
        )
    )


def keyword_match(column: str, keyword: str, literal: bool = False) -> Column:
    """Whether the text contains the keyword: a regular expression, in any case; null does not."""
    if literal:
        hit = F.contains(F.lower(column), F.lit(keyword.lower()))
    else:
        hit = F.col(column).rlike("(?i)" + keyword)
    return F.coalesce(hit, F.lit(False))


def pattern_search(ranked: DataFrame, keyword: str, literal: bool = False) -> DataFrame:
    """The ranked patterns that contain the keyword; all of them for a blank one."""
    keyword = keyword.strip()
    return ranked.filter(keyword_match("pattern", keyword, literal)) if keyword else ranked


def search_totals(found: DataFrame) -> DataFrame:
    """How many patterns were found, and the sessions they stand for."""
    return found.agg(
        F.count(F.lit(1)).alias("patterns"),
        F.coalesce(F.sum("sessions"), F.lit(0)).alias("sessions"),
    )


def patterns_of(session_patterns: DataFrame, sessions: DataFrame) -> DataFrame:
    """The session patterns of the given (filtered) sessions only."""
    return session_patterns.join(sessions.select("session_id"), "session_id", "left_semi")
