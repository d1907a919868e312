"""Keeping stored tables up to date with new raw events.

New events change the dwell times of their sessions, also on other days, and the aggregates of the days of
these sessions. Only those are computed anew: sessions of new events are found by a semi join, their
days are rewritten, everything else stays as it is stored. Partitions are replaced whole, from a copy
that is complete before the first one is touched.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import elapsed_us, seconds
from ..operators import breakdowns, cleaning, funnel
from ..operators import sessions as session_views
from ..operators.ordering import in_order, measured
from ..session import written
from ..sources.readers import read_table
from ..sources.writers import write_table
from ..spec import EventSpec
from .pipeline import clean_events

#: Sessions are stored in so many parts by a hash of their id.
BUCKETS = 64


@dataclass(frozen=True)
class Refreshed:
    """What a refresh touched."""

    events: int
    sessions: int
    days: int


def bucket_of(session_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(session_id), F.lit(buckets)).cast("int")


def _one_of(column: str, values: list) -> Column:
    """Whether a partition is one of those, null among them."""
    known = [v for v in values if v is not None]
    found = F.col(column).isin(known) if known else F.lit(False)
    return F.coalesce(found, F.lit(False)) | F.col(column).isNull() if None in values else F.coalesce(found, F.lit(False))


def _values(df: DataFrame, column: str) -> list:
    """The distinct partition values, as many as there are days or buckets."""
    return [r[0] for r in df.select(column).distinct().collect()]


def _replace(df: DataFrame, path: str, by: str, sort_by: list[str], touched: list) -> None:
    """Put the rows of `df` in the place of the touched partitions of `path`.

    A touched partition that has no rows any more is left with an empty file of its own.
    """
    spark = df.sparkSession
    rows = written(df, "refresh")
    present = _values(rows, by)
    if present:
        write_table(rows, path, partition_by=[by], sort_by=sort_by, mode="overwrite", dynamic=True)
    for value in set(touched) - set(present):
        empty = spark.read.schema(rows.schema).parquet(path).limit(0).drop(by)
        name = "__HIVE_DEFAULT_PARTITION__" if value is None else value
        empty.write.mode("overwrite").parquet(f"{path}/{by}={name}")


def build(raw: DataFrame, spec: EventSpec, folder: str, **options) -> None:
    """The tables that `refresh` keeps: clean events by date, sessions by bucket, the funnel and hours by date."""
    folder = folder.rstrip("/")
    session = spec.columns["session_id"]
    spark = raw.sparkSession
    spec = measured(raw.select(raw[session].cast("string").alias("session_id")), spec)
    write_table(clean_events(raw, spec, **options), f"{folder}/events_clean", partition_by=["date_utc"], sort_by=[session])
    events = cleaning.canonical_events(read_table(spark, f"{folder}/events_clean"), spec)
    rolled = session_views.session_rollup(events, spec).withColumn("bucket", bucket_of(F.col("session_id")))
    write_table(rolled, f"{folder}/sessions", partition_by=["bucket"], sort_by=["session_id"])
    sessions = read_table(spark, f"{folder}/sessions").drop("bucket")
    write_table(funnel.funnel_rollup(sessions, spec), f"{folder}/funnel_rollup", partition_by=["date"])
    write_table(breakdowns.hourly_activity(events, spec), f"{folder}/hourly", partition_by=["date_local"])


def refresh(new: DataFrame, spec: EventSpec, folder: str, **options) -> Refreshed:
    """Add new raw events to the tables of `build`, as if all had been there from the start.

    The new events may belong to stored sessions and lie before their stored events. Events are not
    told apart by id: one that is delivered twice is there twice, as in a full run.
    """
    spark, folder = new.sparkSession, folder.rstrip("/")
    session = spec.columns["session_id"]
    fresh = written(clean_events(new, spec, **options), "refresh-new")
    if fresh.isEmpty():
        return Refreshed(0, 0, 0)
    known = F.col(session).isNotNull()
    touched = written(fresh.filter(known).select(F.col(session).cast("string").alias("touched")).distinct(), "refresh-sessions")

    def of_touched(df: DataFrame, column: str, how: str) -> DataFrame:
        return df.join(touched, df[column].cast("string") == F.col("touched"), how)

    # Events: the days that hold an event of a touched session, or a new one without a session.
    stored = spark.read.schema(fresh.schema).parquet(f"{folder}/events_clean")
    days = _values(of_touched(stored.select(session, "date_utc"), session, "left_semi").unionByName(fresh.select(session, "date_utc")), "date_utc")
    there = stored.filter(_one_of("date_utc", days))
    joined = of_touched(there, session, "left_semi").unionByName(fresh.filter(known))
    rows = of_touched(there, session, "left_anti").unionByName(fresh.filter(~known)).unionByName(_timed(joined, spec))
    _replace(rows.select(*fresh.columns), f"{folder}/events_clean", "date_utc", [session], days)

    # Sessions: the touched ones, from the days their events lie on.
    stored = spark.read.schema(fresh.schema).parquet(f"{folder}/events_clean").filter(_one_of("date_utc", days))
    events = cleaning.canonical_events(stored, spec)
    changed = of_touched(events, "session_id", "left_semi")
    anew = session_views.session_rollup(changed, measured(changed, spec)).withColumn("bucket", bucket_of(F.col("session_id")))
    before = spark.read.schema(anew.schema).parquet(f"{folder}/sessions")
    anew = written(anew, "refresh-rollup")
    buckets = _values(anew, "bucket")
    old = written(of_touched(before.filter(_one_of("bucket", buckets)), "session_id", "left_semi").select("date_utc"), "refresh-days")
    kept = of_touched(before.filter(_one_of("bucket", buckets)), "session_id", "left_anti")
    dates = _values(old.unionByName(anew.select("date_utc")), "date_utc")
    _replace(kept.unionByName(anew), f"{folder}/sessions", "bucket", ["session_id"], buckets)

    # The funnel of the days on which touched sessions began or begin now, the hours of the new events.
    sessions = spark.read.schema(anew.schema).parquet(f"{folder}/sessions").drop("bucket")
    _replace(funnel.funnel_rollup(sessions.filter(_one_of("date_utc", dates)), spec), f"{folder}/funnel_rollup", "date", [], dates)
    hours = _values(cleaning.canonical_events(fresh, spec), "date_local")
    hours = [d for d in hours if d is not None]
    near = spark.read.schema(fresh.schema).parquet(f"{folder}/events_clean").filter(_one_of("date_utc", _beside(hours)))
    found = cleaning.canonical_events(near, spec).filter(_one_of("date_local", hours))
    _replace(breakdowns.hourly_activity(found, spec), f"{folder}/hourly", "date_local", [], [])
    return Refreshed(fresh.count(), touched.count(), len(days))


def _beside(days: list) -> list:
    """UTC dates whose events can have one of these local dates."""
    return sorted({d + timedelta(days=k) for d in days for k in (-1, 0, 1)})


def _timed(clean: DataFrame, spec: EventSpec) -> DataFrame:
    """Clean events of whole sessions with their dwell times computed anew."""
    rows = clean.select(
        clean[spec.columns["id"]].alias("id"),
        clean[spec.columns["session_id"]].cast("string").alias("session_id"),
        "create_ts",
        F.struct(*(F.col(f"`{c}`") for c in clean.columns if c != "duration_sec")).alias("kept"),
    )
    ordered = in_order(rows, measured(rows, spec)).neighbour({"next_ts": "create_ts"}, 1).plain()
    return ordered.select("kept.*", seconds(elapsed_us(F.col("create_ts"), F.col("next_ts"))).alias("duration_sec"))


class SessionIndex:
    """Point lookups of sessions by bucket: one folder, and in it the row groups whose bloom filter has the session."""

    def __init__(self, spark: SparkSession, path: str, spec: EventSpec, buckets: int = BUCKETS) -> None:
        self.spec, self.buckets = spec, buckets
        # Files are listed once, not at each lookup.
        self.events = read_table(spark, path)

    @staticmethod
    def write(events: DataFrame, spec: EventSpec, path: str, buckets: int = BUCKETS, mode: str = "overwrite", **options) -> int:
        """Store what the drill-down shows of canonical events, by bucket and sorted by session."""
        narrow = events.filter(F.col("session_id").isNotNull()).select("id", "session_id", "create_ts", "name", "type", "page_url", "product_name")
        bucketed = narrow.withColumn("bucket", bucket_of(F.col("session_id"), buckets))
        return write_table(bucketed, path, partition_by=["bucket"], sort_by=["session_id"], bloom_by=["session_id"], mode=mode, **options)

    def rows(self, session_id: str) -> DataFrame:
        wanted = F.lit(session_id)
        return self.events.filter((F.col("bucket") == bucket_of(wanted, self.buckets)) & (F.col("session_id") == wanted)).drop("bucket")

    def timeline(self, session_id: str) -> DataFrame:
        return session_views.session_timeline(self.rows(session_id), self.spec)

    def totals(self, session_id: str) -> DataFrame:
        return session_views.session_timeline_totals(self.rows(session_id), self.spec)
