"""The physical plans: no Python, few shuffles, pruned and filtered scans."""

from __future__ import annotations

import re

import pytest

from pyspark.sql import functions as F

from stridelog import canonical_events
from stridelog.operators import dwell, funnel, paths, sessions
from stridelog.plans.pipeline import clean_events
from stridelog.plans.queries import QUERIES
from stridelog.session import fresh_path
from stridelog.sources.demo import CLICKS_SPEC, clicks
from stridelog.sources.writers import write_table

FOLDER = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    return len(re.findall(r"\bExchange (?:hash|range|Single)", plan_of(df)))


@pytest.fixture(scope="module")
def events(spark):
    path = fresh_path(spark, "plan-events")
    clicks(spark, FOLDER).write.parquet(path)
    return canonical_events(spark.read.parquet(path), CLICKS_SPEC)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_cross_join(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert not re.search("EvalPython|InPandas|InArrow|CartesianProduct", plan)
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize(
    "job",
    [
        dwell.dwell_events,
        dwell.active_events,
        sessions.session_rollup,
        sessions.session_timeline,
        paths.event_sequence,
        paths.link_sequence,
        paths.session_pattern,
    ],
    ids=lambda f: f.__name__,
)
def test_session_jobs_shuffle_once(events, job):
    assert exchanges(job(events, CLICKS_SPEC)) == 1


def test_drill_down_filter_reaches_the_scan(events):
    plan = plan_of(sessions.session_timeline(events, CLICKS_SPEC, "s1"))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(session_id,s1\)", plan)


def test_scans_read_only_what_they_need(events):
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan_of(funnel.funnel(events, CLICKS_SPEC)))[1]
    assert sorted(c.split(":")[0] for c in schema.split(",")) == ["name", "session_id"]


def test_drill_down_reads_only_the_days_of_the_session(spark, events):
    path = fresh_path(spark, "plan-clean")
    clean = clean_events(clicks(spark, FOLDER).drop("create_ts_raw"), CLICKS_SPEC, keep=clicks(spark, FOLDER).columns, repair=False)
    write_table(clean, path, partition_by=["date_utc"], sort_by=["session_id"])
    stored = canonical_events(spark.read.parquet(path), CLICKS_SPEC)
    chosen = stored.filter("session_id IS NOT NULL").first()["session_id"]
    whole = sessions.session_timeline(stored, CLICKS_SPEC, chosen).filter("time IS NOT NULL")
    day = stored.filter(F.col("session_id") == chosen).agg(F.min("date_utc"), F.max("date_utc")).first()
    short = sessions.session_timeline(stored, CLICKS_SPEC, chosen, tuple(day))
    assert sorted(map(str, short.collect())) == sorted(map(str, whole.collect()))
    plan = plan_of(short)
    assert re.search(r"PartitionFilters: \[[^\]]*date_utc", plan)
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(session_id", plan)
    assert "try_to_timestamp" not in plan
