"""Stored cubes against the exact operators, and the funnel of ordered steps against brute force."""

from __future__ import annotations

import random
from datetime import date

import pytest
from fixtures import SPEC, at, events_of, only, records
from pyspark.sql import functions as F

from stridelog import FilterSpec
from stridelog.operators import breakdowns, cubes, dwell, funnel, ordered_funnel, sessions
from stridelog.operators.ordering import measured

NAMES = [s.name for s in SPEC.steps]
SLICES = [FilterSpec(), FilterSpec(device="pc"), FilterSpec(source="b", country="VN"), FilterSpec(date_from=date(2024, 1, 1), date_to=date(2024, 1, 1))]


@pytest.fixture(scope="module")
def visits(spark):
    """Many sessions and users of three destinations, so that sketches are past their exact range."""
    n = 120_000
    base = spark.range(n).select(
        F.col("id"),
        F.concat(F.lit("s"), F.col("id") % 50_000).alias("session_id"),
        F.concat(F.lit("u"), F.pmod(F.xxhash64("id"), F.lit(30_000))).alias("profile_id"),
        F.element_at(F.array(*map(F.lit, NAMES)), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)) + 1).cast("int")).alias("name"),
        F.lit("t").alias("type"),
        F.date_format(F.timestamp_seconds(F.lit(1_704_103_200) + F.pmod(F.xxhash64("id", F.lit(2)), F.lit(3 * 86400))), "yyyy-MM-dd HH:mm:ss").alias("created"),
        F.concat(F.lit("https://a.example/du-lich-p"), F.col("id") % 3, F.lit(".aspx")).alias("page_url"),
        F.lit(None).cast("string").alias("product_name"),
        F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit(None)), (F.col("id") % 50_000 % 3 + 1).cast("int")).alias("utm_source"),
        F.when(F.col("id") % 50_000 % 2 == 0, "pc").alias("device_type"),
        F.lit("x").alias("os_name"),
        F.when(F.col("id") % 50_000 % 5 != 0, "VN").alias("geo_country"),
        F.lit("c").alias("geo_city"),
    )
    from stridelog import canonical_events

    return canonical_events(base, SPEC).cache()


def near(estimate, exact, percent):
    return abs(estimate - exact) * 100 <= percent * exact


@pytest.mark.parametrize("filters", SLICES)
def test_destination_cube(visits, filters):
    cube = cubes.destination_cube(visits, SPEC).cache()
    want = {r.destination: r for r in breakdowns.top_destinations(visits, SPEC, filters).collect()}
    got = cubes.destinations_of(cube, filters).collect()
    assert len(got) == len(want) == 3
    for r in got:
        exact = want[r.destination]
        assert r.views == exact.views
        assert near(r.unique_sessions, exact.unique_sessions, 2) and near(r.unique_users, exact.unique_users, 2)


@pytest.mark.parametrize("filters", SLICES)
def test_visitor_cube(visits, filters):
    rolled = sessions.session_rollup(visits, SPEC).cache()
    got = cubes.visitors_of(cubes.visitor_cube(rolled, SPEC), SPEC, filters).orderBy("step_order").collect()
    chosen = filters.apply(rolled)
    want = [chosen, *(chosen.filter(F.col(s.had)) for s in SPEC.steps)]
    for row, exact in zip(got, want, strict=True):
        one = exact.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("profile_id").alias("u")).first()
        assert row.sessions == one.n and near(row.users, one.u, 2)


def test_cubes_of_no_events(visits):
    none = visits.limit(0)
    assert cubes.destinations_of(cubes.destination_cube(none, SPEC)).count() == 0
    assert cubes.dwell_of(cubes.dwell_cube(none, SPEC)).count() == 0
    empty = cubes.visitors_of(cubes.visitor_cube(sessions.session_rollup(none, SPEC), SPEC), SPEC).collect()
    assert [(r.sessions, r.users) for r in empty] == [(0, 0)] * 6


@pytest.mark.parametrize("by", ["link", "name"])
def test_dwell_cube_ranks(visits, by):
    """The rank of an estimated percentile among the exact times is off by 1 % at most."""
    filters = FilterSpec(device="pc")
    spec = SPEC
    timed = dwell.with_dwell(visits, spec, ("link", "name", "date_local", *cubes.SLICES)).withColumn("dwell_us", F.col("dwell_us") % 1_700_000_000).cache()
    cube = cubes.dwell_cube(timed, spec, by)
    exact = filters.apply(dwell.valid_events(timed, spec, (by, *cubes.SLICES), by == "link")).groupBy(by).agg(F.sort_array(F.collect_list("dwell_us")).alias("all"))
    times = {r[by]: r["all"] for r in exact.collect()}
    got = cubes.dwell_of(cube, by, filters).collect()
    assert {r[by] for r in got} == set(times) and sum(len(t) for t in times.values()) > 3000
    for r in got:
        known = times[r[by]]
        assert r.views == len(known) and r.total_time_sec == pytest.approx(sum(known) / 1e6)
        for value, fraction in ((r.median_time_sec, 0.5), (r.p90_time_sec, 0.9)):
            us = round(value * 1e6)
            assert sum(k < us for k in known) / len(known) - 0.01 <= fraction <= sum(k <= us for k in known) / len(known) + 0.01


def test_grains_equal_the_single_tables(spark, visits):
    rolled = sessions.session_rollup(visits, SPEC).cache()
    grains = cubes.funnel_grains(rolled, SPEC).cache()
    reached = [s.reached for s in SPEC.steps]
    cube = funnel.funnel_rollup(rolled, SPEC)
    order = ["date", "device_type", "utm_source", "geo_country"]
    assert records(cubes.grain_of(grains, "cube"), *order) == records(cube, *order)
    whole = only(cubes.grain_of(grains, "overall"))
    assert whole["sessions"] == rolled.count()
    by_device = {(r["device_type"], r["sessions"], r[reached[1]]) for r in records(cubes.grain_of(grains, "device"))}
    assert by_device == {(r.device_type, r.n, r.k) for r in rolled.groupBy("device_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(SPEC.steps[1].had).alias("k")).collect()}
    assert records(funnel.daily_trend(cubes.grain_of(grains, "day"), SPEC), "date", "name") == records(funnel.daily_trend(cube, SPEC), "date", "name")


def test_grains_take_one_scan_and_one_exchange(spark, visits, tmp_path):
    sessions.session_rollup(visits, SPEC).write.parquet(str(tmp_path / "s"))
    plan = cubes.funnel_grains(spark.read.parquet(str(tmp_path / "s")), SPEC)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1 and plan.count("Expand") == 1


# ---- ordered steps ------------------------------------------------------------------------------


def brute(rows, window):
    """Every start of every session followed greedily: {session: [(completed at, took) or None per step]}."""
    out = {}
    for session in {r["session_id"] for r in rows if r.get("session_id")}:
        told = [(r["created"], r["id"], r["name"]) for r in rows if r.get("session_id") == session and r["name"] in NAMES and r["created"]]
        if not told:
            continue
        told.sort()
        best = [None] * len(NAMES)
        for i, (_, _, name) in enumerate(told):
            if name != NAMES[0]:
                continue
            step, chain = 0, i
            for j in range(i, len(told)):
                if step < len(NAMES) and told[j][2] == NAMES[step]:
                    took = j
                    if window is not None and seconds_of(told[j][0]) - seconds_of(told[i][0]) > window:
                        break
                    done = (took, -chain)
                    if best[step] is None or done < best[step]:
                        best[step] = done
                    step += 1
        out[session] = [b and (told[b[0]][0], round((seconds_of(told[b[0]][0]) - seconds_of(told[-b[1]][0])) * 1e6)) for b in best]
    return out


def seconds_of(text):
    hours, minutes, rest = text[11:-1].split(":")
    return int(hours) * 3600 + int(minutes) * 60 + float(rest)


def walk(seed, length, count):
    rng = random.Random(seed)
    rows = []
    for s in range(count):
        for _ in range(rng.randrange(1, length)):
            rows.append({"id": len(rows) + 1, "session_id": f"s{s}", "name": rng.choice([*NAMES, "other"]), "created": at(rng.randrange(0, 400))})
    rows += [{"id": 9000, "session_id": None, "name": NAMES[0], "created": at(1)}, {"id": 9001, "session_id": "s0", "name": NAMES[0], "created": None}]
    rows += [{"id": 9002 + i, "session_id": "tied", "name": n, "created": at(5)} for i, n in enumerate(NAMES)]
    rows += [{"id": 9100 - i, "session_id": "backwards", "name": n, "created": at(5)} for i, n in enumerate(NAMES)]
    return rows


@pytest.mark.parametrize("window", [None, 60, 5])
@pytest.mark.parametrize("hot", [False, True])
def test_reach_in_order(spark, window, hot):
    rows = walk(1, 60, 12)
    spec = SPEC.with_limits(hot_session_rows=6, chunk_rows=7) if hot else SPEC
    events = events_of(spark, *rows, spec=spec)
    if hot:
        spec = measured(events, spec)
        assert spec.hot and spec.hot.sessions > 3
    got = {r.session_id: r for r in ordered_funnel.reach_in_order(events, spec, window).collect()}
    want = brute(rows, window)
    assert set(got) == set(want)
    for session, steps in want.items():
        row = got[session]
        for step, told in zip(SPEC.steps, steps, strict=True):
            assert row[f"us_{step.key}"] == (told and told[1]), (session, step)
            assert (row[f"at_{step.key}"] is None) == (told is None)
            if told:
                assert row[f"at_{step.key}"].strftime("%H:%M:%S") == told[0][11:19]
    assert want["tied"][-1] is not None and want["backwards"][1] is None


def test_ordered_funnel_rows(spark):
    rows = [("a", "view", 0), ("a", "search", 10), ("a", "cart", 30), ("b", "search", 0), ("b", "view", 5), ("c", "view", 0), ("c", "view", 50), ("c", "search", 60)]
    events = events_of(spark, *({"session_id": s, "name": n, "created": at(t)} for s, n, t in rows))
    got = records(ordered_funnel.ordered_funnel(events, SPEC), "step_order")
    assert [(r["step"], r["sessions"], r["from_first_pct"], r["from_previous_pct"], r["median_sec"]) for r in got] == [
        ("view", 3, 100.0, None, 0.0), ("search", 2, 66.67, 66.67, 10.0), ("cart", 1, 33.33, 50.0, 30.0), ("order", 0, 0.0, 0.0, None), ("done", 0, 0.0, None, None),
    ]
