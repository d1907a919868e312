"""Event order inside a session, for sessions of any size.

A window over `session_id` puts a whole session into one task. That is the right plan until one
session (a crawler, a default id) holds a good part of the table. `measured` looks at the session
sizes once per table, and operators given its result treat the sessions over the limit apart: these are
written once in range partitions over (session, time, id), which stay even however the rows are
spread because the id breaks every tie, and are windowed per (session, partition). Only the edges of
those partitions, two rows each, are then matched across. Both plans give the same rows, and an
operator given a spec that was not measured uses the plain one without looking at the data.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from ..spec import EventSpec

CHUNK = "_chunk"  # range partition of a hot session; null elsewhere
SALT = "_salt"  # spreads events without a session; null elsewhere
SALTS = 1 << 20


# Events follow each other by time, unknown times last, the id deciding ties.
def time_order() -> tuple[Column, Column]:
    return F.col("create_ts").asc_nulls_last(), F.col("id").asc()


def time_key() -> Column:
    """The same order as one value to compare."""
    return F.struct(F.col("create_ts").isNull(), F.col("create_ts"), F.col("id"))


@dataclass(frozen=True)
class HotSessions:
    """The sessions too large for one task: a stored table of their names, their number and rows."""

    names: DataFrame
    sessions: int
    rows: int

    #: Up to this many names, or edges of them, are sent to every task.
    MOST_SENT = 500_000

    def sent(self, narrow: DataFrame) -> DataFrame:
        return F.broadcast(narrow) if self.sessions <= self.MOST_SENT else narrow


def measured(events: DataFrame, spec: EventSpec) -> EventSpec:
    """The spec with the sessions of over `limits.hot_session_rows` rows, found by one read of one column."""
    sizes = (
        events.filter(F.col("session_id").isNotNull())
        .groupBy("session_id")
        .agg(F.count(F.lit(1)).alias("rows"))
        .filter(F.col("rows") > spec.limits.hot_session_rows)
    )
    names = written(sizes, "hot-session-names")
    found = names.agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows")).first()
    hot = HotSessions(names.select("session_id"), found["n"], found["rows"]) if found["n"] else None
    return replace(spec, hot=hot)


def split_hot(events: DataFrame, hot: HotSessions) -> tuple[DataFrame, DataFrame]:
    """(the other events, the events of the hot sessions)."""
    names = hot.sent(hot.names)
    return (
        events.join(names, "session_id", "left_anti"),
        events.join(names, "session_id", "left_semi"),
    )


@dataclass(frozen=True)
class Ordered:
    """Events with the keys that bound every window over them."""

    frame: DataFrame
    keys: tuple[str, ...]
    hot: HotSessions | None = None

    def where(self, condition: Column) -> "Ordered":
        return replace(self, frame=self.frame.filter(condition))

    def with_columns(self, columns: Mapping[str, Column]) -> "Ordered":
        return replace(self, frame=self.frame.withColumns(dict(columns)))

    @property
    def window(self):
        return Window.partitionBy(*self.keys).orderBy(*time_order())

    def plain(self) -> DataFrame:
        return self.frame.drop(CHUNK, SALT)

    def _edges(self, columns: tuple[str, ...], pick: Callable) -> DataFrame:
        """One row per (session, partition): its first or last event's columns.

        At most as many as there are hot sessions and partitions of them.
        """
        return (
            self.frame.filter(F.col(CHUNK).isNotNull())
            .groupBy("session_id", CHUNK)
            .agg(pick(F.struct(*columns), time_key()).alias("_edge"))
        )

    def neighbour(self, columns: Mapping[str, str], step: int) -> "Ordered":
        """Add `columns` (new name -> column) of the next (step=1) or previous (-1) event.

        Null at the end of a session, and for events without a session.
        """
        names = tuple(columns.values())
        near = F.lead if step > 0 else F.lag
        beside = near(F.struct(*names)).over(self.window)
        frame = self.frame.withColumn("_beside", beside)
        if self.hot:
            across = Window.partitionBy("session_id").orderBy(CHUNK)
            edges = self._edges(names, F.min_by if step > 0 else F.max_by).select(
                "session_id", CHUNK, near("_edge").over(across).alias("_across")
            )
            frame = frame.join(self.hot.sent(edges), ["session_id", CHUNK], "left").withColumn(
                "_beside", F.coalesce("_beside", "_across")
            )
            frame = frame.drop("_across")
        known = F.col("session_id").isNotNull()
        frame = frame.withColumns(
            {new: F.when(known, F.col("_beside")[old]) for new, old in columns.items()}
        )
        return replace(self, frame=frame.drop("_beside"))

    def largest_before(self, name: str, value: str) -> "Ordered":
        """Add `name`, the largest `value` among the session's events before this one; null if there is none."""
        earlier = self.window.rowsBetween(Window.unboundedPreceding, -1)
        frame = self.frame.withColumn(name, F.max(value).over(earlier))
        if self.hot:
            across = Window.partitionBy("session_id").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
            parts = (
                self.frame.filter(F.col(CHUNK).isNotNull())
                .groupBy("session_id", CHUNK)
                .agg(F.max(value).alias("_part"))
                .select("session_id", CHUNK, F.max("_part").over(across).alias("_parts"))
            )
            frame = (
                frame.join(self.hot.sent(parts), ["session_id", CHUNK], "left")
                .withColumn(name, F.greatest(name, "_parts"))
                .drop("_parts")
            )
        return replace(self, frame=frame)

    def numbered(self, name: str) -> "Ordered":
        """Add the 1-based position of each event among the session's events of this frame."""
        frame = self.frame.withColumn(name, F.row_number().over(self.window).cast("long"))
        if self.hot:
            before = (
                Window.partitionBy("session_id")
                .orderBy(CHUNK)
                .rowsBetween(Window.unboundedPreceding, -1)
            )
            offsets = (
                self.frame.filter(F.col(CHUNK).isNotNull())
                .groupBy("session_id", CHUNK)
                .agg(F.count(F.lit(1)).alias("_n"))
                .select("session_id", CHUNK, F.sum("_n").over(before).alias("_offset"))
            )
            frame = (
                frame.join(self.hot.sent(offsets), ["session_id", CHUNK], "left")
                .withColumn(name, F.col(name) + F.coalesce("_offset", F.lit(0)))
                .drop("_offset")
            )
        return replace(self, frame=frame)


def in_order(events: DataFrame, spec: EventSpec, keep_unknown: bool = False) -> Ordered:
    """Lay `events` out for ordered work per session.

    Events without a session take no part in any order. They are dropped unless `keep_unknown`, and
    are then spread over many window groups instead of sharing one.
    """
    limits, hot = spec.limits, spec.hot
    keys: tuple[str, ...] = ("session_id",)
    if keep_unknown:
        salt = F.when(F.col("session_id").isNull(), F.pmod(F.xxhash64("id"), F.lit(SALTS)))
        events = events.withColumn(SALT, salt)
        keys += (SALT,)
    else:
        events = events.filter(F.col("session_id").isNotNull())
    if not hot:
        return Ordered(events, keys)

    chunks = min(limits.max_chunks, ceil(hot.rows / limits.chunk_rows))
    rest, large = split_hot(events, hot)
    ranged = large.repartitionByRange(chunks, F.col("session_id"), *time_order())
    ranged = written(ranged.withColumn(CHUNK, F.spark_partition_id()), "hot-sessions")
    rest = rest.withColumn(CHUNK, F.lit(None).cast("int"))
    return Ordered(rest.unionByName(ranged), (*keys, CHUNK), hot)
