"""The batch runs end to end, reading and writing, and the relations between their tables."""

from __future__ import annotations

import json

import pytest
from pyspark.errors import AnalysisException
from fixtures import at
from pyspark.sql import functions as F

from stridelog import canonical_events
from stridelog.operators import breakdowns, cleaning, conversion, dwell, funnel, profiling, sessions
from stridelog.plans import pipeline
from stridelog.sources.demo import CLICKS_PII, CLICKS_SPEC, clicks
from stridelog.sources.readers import read_first, read_table
from stridelog.sources.writers import folder_bytes, write_bundle, write_table
from stridelog.spec import travel_spec

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("run"))
    raw = clicks(spark, FOLDER).drop("create_ts_raw")
    rows = pipeline.run_clean(raw, CLICKS_SPEC, folder, keep=raw.columns, pii=CLICKS_PII)
    clean = read_table(spark, f"{folder}/events_clean")
    events = canonical_events(clean, CLICKS_SPEC)
    tables = pipeline.run_aggregates(events, CLICKS_SPEC, f"{folder}/aggregates")
    return folder, rows, clean, events, tables


def table(spark, run, name):
    return spark.read.parquet(f"{run[0]}/aggregates/{name}")


def test_clean_table(spark, run):
    folder, rows, clean, events, _ = run
    assert rows["events_clean"].rows == clean.count() == spark.read.parquet(f"{FOLDER}/events.parquet").count()
    assert not set(CLICKS_PII) & set(clean.columns)
    assert {"create_ts", "link", "duration_sec", "date_utc"} <= set(clean.columns)
    assert rows["event_duration"].rows > 0 and rows["link_duration"].bytes > 0
    assert folder_bytes(spark, f"{folder}/events_clean") > 0
    measured = clean.filter("duration_sec IS NOT NULL").count()
    sessions = events.filter("session_id IS NOT NULL")
    assert measured <= sessions.count() - sessions.select("session_id").distinct().count()


def test_aggregates_agree_with_each_other(spark, run):
    _, _, _, events, rows = run
    sessions = table(spark, run, "sessions")
    n = sessions.count()
    assert n == rows["sessions"].rows == events.select("session_id").distinct().count() - 1  # the null
    total = F.sum("sessions").alias("n")
    for name in ("funnel_rollup", "utm_sources", "device", "patterns"):
        assert table(spark, run, name).agg(total).first()["n"] == n, name
    cube = table(spark, run, "funnel_rollup").agg(
        *(F.sum(s.reached).alias(s.name) for s in CLICKS_SPEC.steps)
    ).first()
    direct = {r["step"]: r["sessions_reaching"] for r in funnel.funnel(events, CLICKS_SPEC).collect()}
    assert cube.asDict() == direct
    hours = breakdowns.hour_of_day(events, CLICKS_SPEC)
    summed = breakdowns.hour_of_day_rate(table(spark, run, "hourly")).drop("intent_rate_pct")
    assert sorted(map(tuple, hours.collect())) == sorted(map(tuple, summed.collect()))


def test_collapsed_paths_have_no_equal_neighbours(spark, run):
    for row in table(spark, run, "session_pattern").collect():
        steps = row["pattern"].split(" > ")
        assert len(steps) == row["steps"]
        assert all(a != b for a, b in zip(steps, steps[1:]))


def test_metadata_document(spark, run):
    (row,) = spark.read.json(f"{run[0]}/aggregates/meta").collect()
    assert row["devices"] == ["mobile", "pc", "tablet"]
    assert row["total_events"] == run[3].count()
    assert json.loads(spark.read.text(f"{run[0]}/aggregates/meta").first()[0])["date_min"]


def test_report_bundle(spark, run, tmp_path):
    sessions, pairs = table(spark, run, "sessions"), table(spark, run, "product_conversion")
    report = pipeline.build_report(run[3], sessions, pairs, CLICKS_SPEC)
    assert len(report) == 14
    rows = write_bundle(report, str(tmp_path / "report"))
    assert rows["journey_per_session"] == sessions.count() and rows["summary"] == 17
    study = write_bundle(pipeline.duration_report(run[3], CLICKS_SPEC), str(tmp_path / "study"), "csv")
    assert study == {"per_event_duration": run[3].count(), "events_per_session": sessions.count(), "summary": 10}


def test_the_batch_can_be_rerun(spark, run, tmp_path):
    raw = clicks(spark, FOLDER).drop("create_ts_raw")
    runs = []
    for _ in range(2):
        done = pipeline.run_clean(raw, CLICKS_SPEC, str(tmp_path), keep=raw.columns, pii=CLICKS_PII, clean_csv=True)
        events = canonical_events(read_table(spark, f"{tmp_path}/events_clean"), CLICKS_SPEC)
        runs.append({k: w.rows for k, w in (done | pipeline.run_aggregates(events, CLICKS_SPEC, f"{tmp_path}/agg")).items()})
    assert runs[0] == runs[1] and runs[0]["events_clean_csv"] == runs[0]["events_clean"]
    with pytest.raises(AnalysisException):
        pipeline.run_clean(raw, CLICKS_SPEC, str(tmp_path), mode="error", keep=raw.columns, pii=CLICKS_PII)
    views = [int(r["views"]) for r in spark.read.option("header", True).csv(f"{tmp_path}/link_duration").collect()]
    assert views == sorted(views, reverse=True)


def test_clean_dwell_times_cross_midnight_and_move_wide_rows_once(spark):
    raw = clicks(spark, FOLDER).drop("create_ts_raw")
    # Sessions of two users' whole lives, so that most cross midnight.
    raw = raw.withColumn("session_id", F.regexp_extract("session_id", "^(s[0-9]+)", 1)).withColumn(
        "session_id", F.when(F.col("id") % 89 == 0, None).otherwise(F.col("session_id"))
    )
    clean = pipeline.clean_events(raw, CLICKS_SPEC, keep=raw.columns, pii=CLICKS_PII)
    plan = clean._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: r["duration_sec"] for r in clean.collect()}
    fresh = dwell.dwell_events(canonical_events(raw, CLICKS_SPEC), CLICKS_SPEC).collect()
    assert got == {r["id"]: r["duration_sec"] for r in fresh}
    assert sum(v is not None for v in got.values()) > 500
    wide = [line for line in plan.split("\n") if "Exchange" in line and "rangepartitioning" in line]
    assert len(wide) == 1


def test_a_csv_file_is_split(spark, tmp_path):
    spark.range(200_000).select(F.col("id"), F.repeat(F.lit("x"), 50).alias("t")).coalesce(1).write.csv(str(tmp_path / "c"), header=True)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        table = read_table(spark, str(tmp_path / "c"), "csv", "id long, t string")
        assert table.rdd.getNumPartitions() > 4 and table.count() == 200_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_travel_table_keeps_57_columns_and_three_derived(spark):
    schema = ", ".join(f"`{c}` string" for c in cleaning.KEEP_COLUMNS[:40]) + ", extra string"
    values = {c: None for c in cleaning.KEEP_COLUMNS[:40]} | {"extra": "gone"}
    values |= {"id": "e1", "session_id": "s", "name": "Page View", "create": at(0),
               "context_page_url": "https://shop.example/x#y", "context_page_title": "Huáº¿"}
    raw = spark.createDataFrame([tuple(values.values())], schema)
    assert len(cleaning.KEEP_COLUMNS) == 64
    assert len(cleaning.missing_columns(raw, cleaning.KEEP_COLUMNS)) == 24
    clean = pipeline.clean_events(raw, travel_spec("shop.example"))
    assert len(clean.columns) == 61  # 57 kept, three derived, and the date it is stored by
    row = clean.first()
    assert row["link"] == "https://shop.example/x" and row["context_page_title"] == "Huế"


def test_csv_keeps_awkward_text(spark, tmp_path):
    rows = [(1, 'a "quoted", one'), (2, "two\nlines"), (3, "back\\slash"), (4, None), (5, "Huế")]
    df = spark.createDataFrame(rows, "id long, t string")
    assert write_table(df, str(tmp_path / "t"), "csv") == 5
    back = read_table(spark, str(tmp_path / "t"), "csv", "id long, t string", multi_line=True)
    assert sorted(map(tuple, back.collect())) == rows
    with pytest.raises(ValueError, match="schema"):
        read_table(spark, str(tmp_path / "t"), "csv")
    with pytest.raises(ValueError, match="format"):
        read_table(spark, str(tmp_path / "t"), "xlsx")


def test_first_existing_source(spark, tmp_path):
    path = str(tmp_path / "b")
    spark.range(3).write.parquet(path)
    sources = [(str(tmp_path / "a"), "csv"), (path, "parquet")]
    assert read_first(spark, sources, "id long").count() == 3
    with pytest.raises(FileNotFoundError, match="nowhere"):
        read_first(spark, [(str(tmp_path / "nowhere"), "parquet")])


def test_files_of_different_schemas_in_one_glob(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "m=1"))
    spark.range(3).withColumn("x", F.lit("v")).write.parquet(str(tmp_path / "m=2"))
    union = read_table(spark, f"{tmp_path}/m=*", merge_schema=True, base_path=str(tmp_path))
    assert union.count() == 5 and union.filter("x IS NULL").count() == 2
    assert set(union.columns) == {"id", "x", "m"}


def test_column_profile(spark):
    df = spark.createDataFrame(
        [(1, "b" * 130, None), (2, "b" * 130, None), (2, None, None)],
        "device_touch int, utm_source string, other string",
    )
    got = {r["column"]: r for r in profiling.column_profile(df, {"other": "mine"}).collect()}
    assert [got["device_touch"][c] for c in ("dtype", "non_null", "nunique", "sample")] == ["int", 3, 2, "1"]
    assert got["utm_source"]["sample"] == "b" * 117 + "..."
    assert (got["other"]["non_null"], got["other"]["nunique"], got["other"]["sample"]) == (0, 0, "")
    assert got["other"]["meaning"] == "mine"
    assert got["device_touch"]["meaning"] == "device: touch"


def test_estimated_profile(spark):
    df = clicks(spark, FOLDER).select("id", "name", "session_duration")
    exact = {r["column"]: r for r in profiling.column_profile(df).collect()}
    for row in profiling.column_profile(df, exact=False).collect():
        full = exact[row["column"]]
        assert (row["non_null"], row["sample"]) == (full["non_null"], full["sample"])
        assert row["nunique"] == pytest.approx(full["nunique"], rel=0.15)


def test_stored_dwell_times_give_the_same_tables(spark, run):
    _, _, clean, stored, _ = run
    fresh = canonical_events(clean.drop("duration_sec"), CLICKS_SPEC)
    assert "dwell_us" in stored.columns and "dwell_us" not in fresh.columns
    rolled = sessions.session_rollup(fresh, CLICKS_SPEC)
    for job in (
        lambda e: dwell.active_events(e, CLICKS_SPEC),
        lambda e: dwell.link_dwell(e, CLICKS_SPEC),
        lambda e: dwell.event_dwell(e, CLICKS_SPEC),
        lambda e: conversion.product_conversion(e, rolled, CLICKS_SPEC),
        lambda e: profiling.pipeline_summary(e, CLICKS_SPEC),
    ):
        assert sorted(map(str, job(stored).collect())) == sorted(map(str, job(fresh).collect()))
    plan = dwell.active_events(stored, CLICKS_SPEC)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
