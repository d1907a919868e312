"""Stored tables kept up to date, point lookups, and sets of tables published as a whole."""

from __future__ import annotations

import pytest
from fixtures import records
from pyspark.sql import functions as F

from stridelog import canonical_events
from stridelog.operators import sessions
from stridelog.plans import pipeline, refresh
from stridelog.sources import generations
from stridelog.sources.demo import CLICKS_PII, CLICKS_SPEC, clicks
from stridelog.sources.writers import Written

FOLDER = "/root/testdata/sf0.001"
TABLES = ("events_clean", "sessions", "funnel_rollup", "hourly")


def sorted_rows(df):
    columns = sorted(df.columns)
    return sorted((tuple(r) for r in df.select(*(f"`{c}`" for c in columns)).collect()), key=repr)


@pytest.fixture(scope="module")
def raw(spark):
    return clicks(spark, FOLDER).drop("create_ts_raw").cache()


@pytest.mark.parametrize("limit", [2_000_000, 3])
def test_refresh_equals_a_full_run(spark, raw, tmp_path, limit):
    """Two refreshes, of events of old and new sessions, on old and new days, with and without a time or session."""
    spec = CLICKS_SPEC.with_limits(hot_session_rows=limit, chunk_rows=4)
    options = {"keep": raw.columns, "pii": CLICKS_PII}
    third = F.pmod(F.xxhash64("id"), F.lit(10))
    refresh.build(raw, spec, f"{tmp_path}/whole", **options)
    refresh.build(raw.filter(third < 6), spec, f"{tmp_path}/grown", **options)
    untouched = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "grown/events_clean").iterdir() if f.is_dir()}
    first = raw.filter((third == 6) & (F.col("create_text") < "2024-01-06"))
    told = refresh.refresh(first, spec, f"{tmp_path}/grown", **options)
    assert told.events == first.count() > 0 and told.sessions > 0 and 0 < told.days < len(untouched)
    rest = raw.filter((third > 6) | ((third == 6) & ~F.coalesce(F.col("create_text") < "2024-01-06", F.lit(False))))
    refresh.refresh(rest, spec, f"{tmp_path}/grown", **options)
    assert refresh.refresh(raw.limit(0), spec, f"{tmp_path}/grown", **options) == refresh.Refreshed(0, 0, 0)
    for name in TABLES:
        whole, grown = (spark.read.parquet(f"{tmp_path}/{side}/{name}") for side in ("whole", "grown"))
        assert sorted_rows(grown) == sorted_rows(whole), name


def test_refresh_moves_a_session_to_an_earlier_day(spark, raw, tmp_path):
    """The only session of a day begins earlier now: its old day has no funnel row left."""
    columns = raw.columns
    late = raw.limit(1).withColumns({"id": F.lit(1).cast("long"), "session_id": F.lit("moved"), "create_text": F.lit("2025-05-02 01:00:00")}).select(*columns)
    early = late.withColumns({"id": F.lit(2).cast("long"), "create_text": F.lit("2025-05-01 23:30:00")}).select(*columns)
    options = {"keep": columns, "pii": CLICKS_PII}
    refresh.build(late, CLICKS_SPEC, str(tmp_path), **options)
    refresh.refresh(early, CLICKS_SPEC, str(tmp_path), **options)
    (row,) = spark.read.parquet(f"{tmp_path}/funnel_rollup").collect()
    assert str(row.date) == "2025-05-01" and row.sessions == 1
    times = {r.id: r.duration_sec for r in spark.read.parquet(f"{tmp_path}/events_clean").collect()}
    assert times == {2: 5400.0, 1: None}


def scan_metrics(df):
    """The numbers of the plan's scan, once it ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if hasattr(plan, "executedPlan") and "AdaptiveSparkPlan" in plan.nodeName() else plan
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if "Stage" in leaf.nodeName():
            leaf = leaf.plan().collectLeaves().apply(0)
        if "Scan" in leaf.nodeName():
            metrics = leaf.metrics()
            return {k: metrics.apply(k).value() for k in ("numFiles", "numOutputRows")}


def test_lookup_reads_one_file_and_one_row_group(spark, tmp_path):
    """200,000 events of 20,000 sessions whose ids say nothing about their place: one file, one row group of it."""
    events = spark.range(200_000).select(
        F.col("id"), F.sha2((F.col("id") % 20_000).cast("string"), 256).alias("session_id"), F.timestamp_seconds(F.col("id") + 1_704_000_000).alias("create_ts"),
        F.lit("view").alias("name"), F.lit("t").alias("type"), F.sha2(F.col("id").cast("string"), 512).alias("page_url"), F.lit(None).cast("string").alias("product_name"),
    )
    path = str(tmp_path / "index")
    group = {"parquet.block.size": 128 * 1024, "parquet.page.size.row.check.min": 100, "parquet.block.size.row.check.min": 100}
    refresh.SessionIndex.write(events, CLICKS_SPEC, path, buckets=4, **group)
    index = refresh.SessionIndex(spark, path, CLICKS_SPEC, buckets=4)
    wanted = events.filter("id = 777").first()["session_id"]
    found = index.rows(wanted)
    seen = scan_metrics(found)
    assert seen["numFiles"] == 1 and 10 <= seen["numOutputRows"] < 5_000, seen
    assert sorted(r.id for r in found.collect()) == [777 + 20_000 * k for k in range(10)]
    absent = scan_metrics(index.rows("f" * 64))
    assert absent["numFiles"] <= 1 and absent["numOutputRows"] == 0, absent


def test_index_gives_the_timeline_of_the_events(spark, raw, tmp_path):
    events = canonical_events(raw, CLICKS_SPEC)
    path = str(tmp_path / "index")
    refresh.SessionIndex.write(events, CLICKS_SPEC, path)
    index = refresh.SessionIndex(spark, path, CLICKS_SPEC)
    for r in events.filter("session_id IS NOT NULL").select("session_id").distinct().limit(3).collect():
        assert records(index.timeline(r.session_id), "step") == records(sessions.session_timeline(events, CLICKS_SPEC, r.session_id), "step")
        assert records(index.totals(r.session_id)) == records(sessions.session_timeline_totals(events, CLICKS_SPEC, r.session_id))
    assert index.timeline("nobody").count() == 0


# ---- generations --------------------------------------------------------------------------------


def test_generations_switch_as_a_whole(spark, tmp_path):
    folder = str(tmp_path / "set")
    tables = lambda n: {"a": spark.range(n), "b": spark.range(2 * n)}
    with pytest.raises(FileNotFoundError):
        generations.current(spark, folder)
    first = pipeline.publish_report(tables(3), folder)
    pinned = generations.current(spark, folder)
    assert pinned == first and pinned.tables["b"].rows == 6

    def killed(path):
        spark.range(100).write.parquet(f"{path}/a")
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        generations.publish(spark, folder, killed)
    assert generations.current(spark, folder) == first
    second = pipeline.publish_report(tables(5), folder)
    assert generations.numbers(spark, folder) == [1, 2] and second.number == 2
    # The reader of the first still has both of its tables.
    assert (pinned.table(spark, "a").count(), pinned.table(spark, "b").count()) == (3, 6)
    now = generations.current(spark, folder)
    assert (now.table(spark, "a").count(), now.table(spark, "b").count()) == (5, 10)
    assert generations.current(spark, folder, 1) == first
    with pytest.raises(KeyError):
        now.path("c")


def test_two_publishers_do_not_mix(spark, tmp_path):
    """The one that switches second fails, and the first one's set stays."""
    folder = str(tmp_path / "set")

    def slow(path):
        pipeline.publish_report({"a": spark.range(1)}, folder)
        spark.range(9).write.parquet(f"{path}/a")
        return {"a": Written(9, 0)}

    with pytest.raises(Exception, match="exist"):
        generations.publish(spark, folder, slow)
    assert generations.numbers(spark, folder) == [1]
    assert generations.current(spark, folder).table(spark, "a").count() == 1


def test_old_generations_go(spark, tmp_path):
    folder = str(tmp_path / "set")
    for n in (1, 2, 3):
        pipeline.publish_report({"a": spark.range(n)}, folder)
    assert generations.drop_old(spark, folder, keep=2) == [1]
    assert generations.numbers(spark, folder) == [2, 3]
    assert generations.current(spark, folder, 2).table(spark, "a").count() == 2
    assert len(list((tmp_path / "set/data").iterdir())) == 2


def test_aggregates_are_published(spark, raw, tmp_path):
    events = canonical_events(raw, CLICKS_SPEC)
    made = pipeline.publish_aggregates(events, CLICKS_SPEC, str(tmp_path))
    now = generations.current(spark, str(tmp_path))
    assert now == made and now.table(spark, "sessions").count() == made.tables["sessions"].rows > 0
    assert now.table(spark, "meta", "json").count() == 1
    assert {"destination_cube", "visitor_cube", "link_dwell_cube", "event_dwell_cube", "funnel_grains", "reach_in_order"} <= set(now.tables)
