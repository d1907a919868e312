"""The funnel of steps that follow each other in time.

A step counts only after the step before it. The events of a session pass an automaton with one state
per step: the latest time of the first step from which a chain leads there. An event of step k moves the
state of step k - 1, as it was before the event, to step k, if it is not older than the window allows. The
latest start is the best one for every later event, so one state per step is enough. A state is a running
maximum, and maxima of consecutive parts of a session compose: parts of a hot session are run on their
own and joined by the maxima of the parts before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import percent
from ..functions.times import naive, seconds
from ..spec import EventSpec
from .ordering import in_order
from .statistics import percentiles


def _took(key: str) -> str:
    return f"us_{key}"


def reach_in_order(events: DataFrame, spec: EventSpec, window_seconds: int | None = None) -> DataFrame:
    """One row per session with a step event: for each step, when it was first reached in order and how long that took.

    `at_<step>` is the time of the event that completes the first chain to the step, `us_<step>` the microseconds
    since that chain's first step; null where the step is not reached. With a window, a chain may take that long at
    most. Events at one time follow each other by id; events without a time or a session take no part.
    """
    names = [s.name for s in spec.steps]
    told = events.filter(F.col("name").isin(*names) & F.col("create_ts").isNotNull())
    ordered = in_order(told.select("id", "session_id", "create_ts", "name"), spec)
    ordered = ordered.with_columns({"_at": F.unix_micros("create_ts")})
    at = F.col("_at")
    for i, step in enumerate(spec.steps):
        here = F.col("name") == step.name
        if not i:
            ordered = ordered.with_columns({f"_from_{step.key}": F.when(here, at)})
            continue
        ordered = ordered.largest_before("_before", f"_from_{spec.steps[i - 1].key}")
        before = F.col("_before")
        able = here & before.isNotNull()
        if window_seconds is not None:
            able &= at - before <= window_seconds * 1_000_000
        ordered = ordered.with_columns({f"_from_{step.key}": F.when(able, before)})

    def first(step, value: Column) -> Column:
        return F.min_by(value, F.when(F.col(f"_from_{step.key}").isNotNull(), F.struct("_at", "id")))

    return ordered.plain().groupBy("session_id").agg(
        *(naive(first(s, F.col("create_ts"))).alias(f"at_{s.key}") for s in spec.steps),
        *(first(s, at - F.col(f"_from_{s.key}")).alias(_took(s.key)) for s in spec.steps),
    )


def ordered_funnel(events: DataFrame, spec: EventSpec, window_seconds: int | None = None) -> DataFrame:
    """Per step: sessions that reach it in order, shares of the first and of the step before, median and p90 time to get there.

    Shares are null after a step that nobody reached, and for the first step in `from_previous_pct`.
    """
    return funnel_of_reach(reach_in_order(events, spec, window_seconds), spec)


def funnel_of_reach(reach: DataFrame, spec: EventSpec) -> DataFrame:
    """The funnel of the rows of `reach_in_order`, of all of them or of a slice."""
    totals = reach.agg(*(F.count(_took(s.key)).alias(s.key) for s in spec.steps))
    rows = [
        F.struct(
            F.lit(i + 1).alias("step_order"),
            F.lit(s.name).alias("step"),
            F.col(s.key).alias("sessions"),
            percent(F.col(s.key), F.col(spec.steps[0].key), 2).alias("from_first_pct"),
            (percent(F.col(s.key), F.col(spec.steps[i - 1].key), 2) if i else F.lit(None).cast("double")).alias("from_previous_pct"),
        )
        for i, s in enumerate(spec.steps)
    ]
    took = reach.select(F.inline(F.array(*(F.struct(F.lit(i + 1).alias("step_order"), F.col(_took(s.key)).alias("us")) for i, s in enumerate(spec.steps)))))
    middle = percentiles(took, ["step_order"], "us", {"median_us": 0.5, "p90_us": 0.9})
    return totals.select(F.inline(F.array(*rows))).join(middle, "step_order", "left").select(
        "step_order", "step", "sessions", "from_first_pct", "from_previous_pct", seconds(F.col("median_us")).alias("median_sec"), seconds(F.col("p90_us")).alias("p90_sec")
    )
