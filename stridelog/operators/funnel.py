"""How many sessions reach each step: overall, per slice, per day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import count_true, percent
from ..spec import EventSpec, FilterSpec

STEP_ORDER = "step_order"


def _reached(spec: EventSpec) -> list[Column]:
    return [count_true(F.col(s.had)).alias(s.reached) for s in spec.steps]


def _steps_to_rows(spec: EventSpec, **per_step) -> Column:
    """One struct per step, to explode; `per_step` maps a field to a function of the step number."""
    return F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(i + 1).alias(STEP_ORDER),
                    F.lit(s.name).alias("step"),
                    *(value(i).alias(field) for field, value in per_step.items()),
                )
                for i, s in enumerate(spec.steps)
            )
        )
    ).alias("row")


def funnel(events: DataFrame, spec: EventSpec) -> DataFrame:
    """Sessions reaching each step, their share of all, and the drop from the step before.

    Steps are counted independently of each other and of their order in time. The drop is null for
    the first step and after a step nobody reached.
    """
    per_session = (
        events.filter(F.col("session_id").isNotNull())
        .groupBy("session_id")
        .agg(*(F.bool_or(F.col("name") == s.name).alias(s.had) for s in spec.steps))
    )
    totals = per_session.agg(F.count(F.lit(1)).alias("total"), *_reached(spec))

    def reached(i: int) -> Column:
        return F.col(spec.steps[i].reached)

    def drop(i: int) -> Column:
        if i == 0:
            return F.lit(None).cast("double")
        return percent(reached(i - 1) - reached(i), reached(i - 1), 2)

    rows = _steps_to_rows(
        spec,
        sessions_reaching=reached,
        share_pct=lambda i: percent(reached(i), F.col("total"), 2),
        drop_pct=drop,
    )
    return totals.select(rows).select(
        "row.step_order",
        "row.step",
        "row.sessions_reaching",
        F.col("row.share_pct").alias("share_of_all_sessions_pct"),
        F.col("row.drop_pct").alias("drop_from_previous_pct"),
    )


def funnel_of_sessions(sessions: DataFrame, spec: EventSpec) -> DataFrame:
    """The funnel of a (filtered) session table.

    The drop compares with the last earlier step that anyone reached, and is 0 if there is none.
    """
    totals = sessions.agg(*_reached(spec))

    def reached(i: int) -> Column:
        return F.col(spec.steps[i].reached)

    def drop(i: int) -> Column:
        earlier = [F.nullif(reached(j), F.lit(0)) for j in range(i - 1, -1, -1)]
        if not earlier:
            return F.lit(0.0)
        before = F.coalesce(*earlier)
        return F.coalesce(percent(before - reached(i), before, 1), F.lit(0.0))

    return totals.select(_steps_to_rows(spec, sessions=reached, drop_pct=drop)).select("row.*")


def funnel_by_device(sessions: DataFrame, spec: EventSpec) -> DataFrame:
    """Sessions and rate per device and step; sessions of no known device are left out."""
    per_device = (
        sessions.filter(F.col("device_type").isNotNull())
        .groupBy(F.col("device_type").alias("device"))
        .agg(F.count(F.lit(1)).alias("total"), *_reached(spec))
    )
    rows = _steps_to_rows(
        spec,
        sessions=lambda i: F.col(spec.steps[i].reached),
        rate_pct=lambda i: percent(F.col(spec.steps[i].reached), F.col("total"), 2),
    )
    return per_device.select("device", rows).select("device", "row.*")


def funnel_rollup(sessions: DataFrame, spec: EventSpec, date_column: str = "date_utc") -> DataFrame:
    """The cube (date, device, source, country) -> sessions and sessions per step, nulls kept."""
    return sessions.groupBy(
        F.col(date_column).alias("date"), "device_type", "utm_source", "geo_country"
    ).agg(F.count(F.lit(1)).alias("sessions"), *_reached(spec))


def daily_trend(
    cube: DataFrame, spec: EventSpec, filters: FilterSpec | None = None
) -> DataFrame:
    """Step counts per day from the cube, one row per day and step that occurred."""
    if filters is not None:
        cube = filters.apply(cube, date_column="date")
    per_day = (
        cube.filter(F.col("date").isNotNull())
        .groupBy("date")
        .agg(*(F.sum(s.reached).alias(s.reached) for s in spec.steps))
    )
    rows = _steps_to_rows(spec, count=lambda i: F.col(spec.steps[i].reached))
    return (
        per_day.select("date", rows)
        .select("date", F.col("row.step").alias("name"), F.col("row.count").alias("count"))
        .filter(F.col("count") > 0)
    )
