"""Rollups of an event stream: session windows and hours, closed by a watermark.

The same functions take a stored table or a stream of raw events, so a stream gives the rows of the batch
for every window that is closed. A session window ends when its session has been silent for `gap`; an event
that comes later than `late` after the newest one seen may find its window closed and is then left out.
State holds the open windows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.rates import count_true
from ..functions.times import elapsed_us, naive
from ..operators.cleaning import canonical_events
from ..operators.ordering import time_key
from ..operators.sessions import FIRST_SEEN, first_known
from ..spec import EventSpec


def _timed(raw: DataFrame, spec: EventSpec, late: str) -> DataFrame:
    """Canonical events with a time; a stream also gets the watermark."""
    events = canonical_events(raw, spec).filter(F.col("create_ts").isNotNull())
    return events.withWatermark("create_ts", late) if raw.isStreaming else events


def session_windows(raw: DataFrame, spec: EventSpec, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """One row per session and stretch without a silence of `gap`: attributes, events, step flags, length.

    The columns are those of the session rollup as far as a stream can have them: distinct links and
    local dates are left to the batch.
    """
    events = _timed(raw, spec, late).filter(F.col("session_id").isNotNull())
    rolled = events.groupBy("session_id", F.session_window("create_ts", gap).alias("window")).agg(
        *(first_known(c, time_key()).alias(c) for c in FIRST_SEEN),
        F.min("create_ts").alias("first_ts"),
        F.max("create_ts").alias("last_ts"),
        F.count(F.lit(1)).alias("num_events"),
        *(F.coalesce(F.bool_or(F.col("name") == s.name), F.lit(False)).alias(s.had) for s in spec.steps),
    )
    length = elapsed_us(F.col("first_ts"), F.col("last_ts"))
    return rolled.select(
        "session_id",
        "profile_id",
        naive(F.col("first_ts")).alias("started_at"),
        naive(F.col("last_ts")).alias("ended_at"),
        "num_events",
        *FIRST_SEEN[1:],
        *(s.had for s in spec.steps),
        F.to_date(naive(F.col("first_ts"))).alias("date_utc"),
        F.round(length / F.lit(60_000_000.0), 2).alias("session_duration_min"),
    )


def hourly_windows(raw: DataFrame, spec: EventSpec, late: str = "1 hour") -> DataFrame:
    """Page views and intent events per hour, as the hourly table has them, by the local hour's start."""
    view = F.col("name") == spec.view_event
    intent = F.col("name").isin(*spec.intent_events)
    counted = _timed(raw, spec, late).filter(view | intent).groupBy(F.window("create_ts", "1 hour").alias("window"))
    counts = counted.agg(count_true(view).alias("page_views"), count_true(intent).alias("intent_events"))
    local = naive(F.col("window.start")) + F.make_dt_interval(hours=F.lit(spec.utc_offset_hours))
    return counts.select(F.to_date(local).alias("date_local"), F.hour(local).alias("hour_local"), "page_views", "intent_events")


def append_to(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write closed windows to Parquet as far as the stream has data now, and stop; called again, go on from there.

    `checkpoint` keeps the position and the open windows in a shared folder, so a run that was killed is
    repeated without losing or doubling rows.
    """
    return rows.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
