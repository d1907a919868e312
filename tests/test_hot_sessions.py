"""A session too large for one task gives the same rows as any other."""

from __future__ import annotations

from collections import Counter
from itertools import groupby

import pytest
from fixtures import SPEC, at, raw_events, records
from pyspark.sql import functions as F

from stridelog import canonical_events
from stridelog.operators import conversion, dwell, paths, sessions
from stridelog.operators.ordering import in_order, measured
from stridelog.plans.pipeline import clean_events

NAMES = ("view", "view", "search", None, "cart", "cart", "cart", "order", "view")
LOW = SPEC.with_limits(hot_session_rows=60, chunk_rows=25)


@pytest.fixture(scope="module")
def events(spark):
    """One session of 400 events, most at one instant, small ones, and events without a session."""
    rows = []
    for i in range(400):
        second = 5 if 50 <= i < 300 else i
        rows.append(("big", None if i % 29 == 0 else at(second), NAMES[(i * i + i // 3) % 9]))
    for s in range(40):
        rows += [(f"s{s:02d}", at(s * 10 + i * 7), NAMES[(s + i) % 9]) for i in range(3)]
    rows += [(None, at(i), "view") for i in range(50)]
    order = sorted(range(len(rows)), key=lambda i: (i * 7919) % 10007)
    table = raw_events(
        spark,
        *(
            {
                "id": i,
                "session_id": rows[i][0],
                "created": rows[i][1],
                "name": rows[i][2],
                "profile_id": f"p{i % 3}",
                "page_url": None if i % 11 == 0 else f"https://a.example/x-pid-{i % 4}",
                "product_name": None if i % 5 else f"product {i % 4}",
                "utm_source": None if i % 2 else f"src{i % 5}",
            }
            for i in order
        ),
    )
    return canonical_events(table, SPEC).persist()


@pytest.fixture(scope="module")
def hot(events):
    return measured(events, LOW)


def same(left, right):
    assert left.columns == right.columns
    assert Counter(map(tuple, left.collect())) == Counter(map(tuple, right.collect()))


def test_only_the_large_session_is_hot(events, hot):
    assert [r["session_id"] for r in hot.hot.names.collect()] == ["big"] and hot.hot.rows == 400
    assert measured(events, SPEC).hot is None


def test_the_large_session_is_spread_evenly(events, hot):
    ordered = in_order(events, hot)
    sizes = [
        r["count"]
        for r in ordered.frame.filter("_chunk IS NOT NULL").groupBy("_chunk").count().collect()
    ]
    assert sum(sizes) == 400 and len(sizes) >= 8 and max(sizes) <= 100


@pytest.mark.parametrize(
    "job",
    [
        dwell.dwell_events,
        dwell.active_events,
        dwell.link_dwell,
        dwell.event_dwell,
        sessions.session_rollup,
        sessions.session_timeline,
        sessions.session_timeline_totals,
        paths.event_sequence,
        paths.link_sequence,
        paths.session_pattern,
    ],
    ids=lambda f: f.__name__,
)
def test_same_rows_as_the_plain_plan(events, hot, job):
    same(job(events, hot), job(events, SPEC))


def test_conversion_is_the_same(events, hot):
    def pairs(spec):
        return conversion.product_conversion(
            events, sessions.session_rollup(events, spec), spec
        )

    same(pairs(hot), pairs(SPEC))


def brute_force_names(events):
    rows = [r for r in events.collect() if r["session_id"] == "big"]
    rows.sort(key=lambda r: (r["create_ts"] is None, r["create_ts"] or 0, r["id"]))
    return [r["name"] or "None" for r in rows]


def test_large_sequence_against_brute_force(events, hot, monkeypatch):
    monkeypatch.setattr(paths, "RUN", 30)
    row = paths.event_sequence(events, hot).filter("session_id = 'big'").first()
    assert row["event_sequence"] == " > ".join(brute_force_names(events)) and row["items"] == 400


def test_large_pattern_against_brute_force(events, hot):
    collapsed = [name for name, _ in groupby(brute_force_names(events))]
    row = paths.session_pattern(events, hot).filter("session_id = 'big'").first()
    assert row["pattern"] == " > ".join(collapsed) and row["steps"] == len(collapsed)


def test_long_paths_share_a_pattern_only_if_equal(events):
    """Renamed copies of a long session fall together; a change in its middle sets one apart."""
    big = events.filter("session_id = 'big'")
    copies = [big.withColumn("session_id", F.lit(f"copy{i}")) for i in range(2)]
    changed = big.withColumn("session_id", F.lit("changed")).withColumn(
        "name", F.when(F.col("id") == 170, F.lit("other")).otherwise(F.col("name"))
    )
    four = big.unionByName(copies[0]).unionByName(copies[1]).unionByName(changed)
    spec = measured(four, LOW)
    found = paths.patterns(paths.session_pattern(four, spec)).collect()
    assert [r["sessions"] for r in found] == [3, 1]
    assert len(paths.pattern_search(paths.pattern_counts(paths.session_pattern(four, spec)), "other").collect()) == 1


@pytest.mark.parametrize("split", [False, True])
def test_a_very_long_path_is_searched_to_its_end(spark, split):
    n = 50_000
    long = spark.range(n).select(
        F.col("id"),
        F.lit("long").alias("session_id"),
        F.timestamp_seconds(F.col("id")).alias("create_ts"),
        F.when(F.col("id") == n - 1, "order").when(F.col("id") % 2 == 0, "view").otherwise("search").alias("name"),
        F.lit("https://a.example/").alias("link"),
    )
    spec = measured(long, SPEC.with_limits(hot_session_rows=1000, chunk_rows=5000)) if split else SPEC
    assert bool(spec.hot) == split
    patterns = paths.session_pattern(long, spec)
    row = patterns.first()
    assert row["steps"] == n and row["pattern"].count(" > ") == n - 1
    assert paths.pattern_search(paths.pattern_counts(patterns), "search > view > order$").count() == 1
    assert paths.event_sequence(long, spec).count() == paths.link_sequence(long, spec).count() == 1


def test_plain_session_jobs_run_nothing_before_an_action(spark):
    few = canonical_events(raw_events(spark, {"id": 1, "session_id": "a", "created": at(0), "name": "view"}), SPEC)
    group = "building"
    spark.sparkContext.setJobGroup(group, group)
    paths.patterns(paths.session_pattern(few, SPEC))
    sessions.session_rollup(few, SPEC)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == []


def test_all_pattern_ranks_by_ranges(events):
    patterns = paths.session_pattern(events, SPEC)
    counts = paths.pattern_counts(patterns).orderBy(*paths.pattern_order()).collect()
    ranked = paths.ranked_patterns(patterns).orderBy("rank").collect()
    assert [(i + 1, *c) for i, c in enumerate(map(tuple, counts))] == [tuple(r) for r in ranked]


def test_clean_events_with_a_hot_day(spark):
    """A session with most rows of its date, over many ranges, cleaned as by the plain plan."""
    rows = [{"session_id": "big", "name": "view", "created": at(i // 3), "page_url": f"https://a.example/p{i}"} for i in range(300)]
    rows += [{"session_id": f"s{i % 7}", "name": "cart", "created": at(i * 800)} for i in range(60)]
    rows += [{"session_id": "big", "name": "done", "created": None}, {"session_id": None, "name": "view", "created": at(1)}]
    raw = raw_events(spark, *rows)
    spec = SPEC.with_limits(hot_session_rows=50, chunk_rows=40)
    seen = measured(raw.select("session_id"), spec)
    assert seen.hot.sessions == 1
    options = {"keep": raw.columns, "pii": ()}
    plain, split = (clean_events(raw, s, **options) for s in (spec, seen))
    assert plain.columns == split.columns
    assert records(plain, "id") == records(split, "id")
    assert sum(r["duration_sec"] is not None for r in records(split)) > 300
