"""Answers from the smallest stored table that can give them.

Each stored table has columns to filter and group by and measures that can be added up from its rows. A
question names measures, a slice and grouping columns; of the tables that have all of these the one
with the fewest rows is read, and the events only if there is none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rates import count_true
from ..operators import sessions as session_views
from ..operators.cubes import GRAINS, SLICES, grain_of
from ..sources.generations import Generation
from ..spec import EventSpec, FilterSpec

KEYS = ("date", *SLICES)


@dataclass(frozen=True)
class Table:
    """One way to answer: its rows (none: not known, the last resort), its keys, and an aggregate for each measure."""

    name: str
    rows: int | None
    keys: tuple[str, ...]
    measures: Mapping[str, Column]
    read: Callable[[], DataFrame]


def _summed(names: Iterable[str]) -> dict[str, Column]:
    return {name: F.coalesce(F.sum(name), F.lit(0)) for name in names}


def session_measures(spec: EventSpec) -> dict[str, Column]:
    """What rows of sessions can give: counts, sessions per step, exact users."""
    counts = {"sessions": F.count(F.lit(1)), "events": F.coalesce(F.sum("num_events"), F.lit(0)), "users": F.count_distinct("profile_id")}
    return counts | {s.reached: count_true(F.col(s.had)) for s in spec.steps}


class Router:
    """The stored tables of one generation; `events` is asked where they cannot answer."""

    def __init__(self, spark: SparkSession, stored: Generation, spec: EventSpec, events: DataFrame | None = None) -> None:
        reached = [s.reached for s in spec.steps]
        additive = _summed(["sessions", *reached])
        near = {"users_near": F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("users")), F.lit(0).cast("long"))}
        dated = lambda df: df.withColumn("date", F.col("date_utc"))
        self.tables: list[Table] = []

        def add(name: str, keys: tuple[str, ...], measures: Mapping[str, Column], read=None, rows: int | None = None) -> None:
            if name in stored.tables:
                known = stored.tables[name].rows if rows is None else rows
                self.tables.append(Table(name, known, keys, measures, read or (lambda: stored.table(spark, name))))

        add("funnel_rollup", KEYS, additive)
        add("visitor_cube", KEYS, additive | near)
        add("sessions", KEYS, session_measures(spec), lambda: dated(stored.table(spark, "sessions")))
        if "funnel_grains" in stored.tables:
            # The coarse grains are a few rows each; how many is a matter of one small group by.
            sizes = {r["grain"]: r["count"] for r in stored.table(spark, "funnel_grains").groupBy("grain").count().collect()}
            for grain, kept in GRAINS.items():
                if grain != "cube":
                    add("funnel_grains", kept, additive, lambda g=grain: grain_of(stored.table(spark, "funnel_grains"), g), sizes.get(grain, 0))
        if events is not None:
            rolled = lambda: dated(session_views.session_rollup(events, spec))
            self.tables.append(Table("events", None, KEYS, session_measures(spec), rolled))

    def choose(self, measures: Iterable[str], filters: FilterSpec | None = None, by: Iterable[str] = ()) -> Table:
        """The smallest table with all the measures and columns; an error names what no table has."""
        needed = set((filters or FilterSpec()).parts("date")) | set(by)
        able = [t for t in self.tables if needed <= set(t.keys) and set(measures) <= set(t.measures)]
        if not able:
            raise ValueError(f"no stored table has {sorted(measures)} by {sorted(needed)}, and no events are given")
        return min(able, key=lambda t: (t.rows is None, t.rows or 0))

    def answer(self, measures: Iterable[str], filters: FilterSpec | None = None, by: Iterable[str] = ()) -> DataFrame:
        """One row per group of `by` with the measures over the slice; one row in all without `by`."""
        measures, by = list(measures), list(by)
        table = self.choose(measures, filters, by)
        rows = (filters or FilterSpec()).apply(table.read(), date_column="date")
        return rows.groupBy(*by).agg(*(table.measures[m].alias(m) for m in measures))
