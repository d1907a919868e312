"""Null, order, type and boundary rules, each on a few literal rows."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from fixtures import SPEC, at, events_of, only, raw_events, records
from pyspark.sql import functions as F

from stridelog import FilterSpec, canonical_events, homepage_spellings, travel_spec
from stridelog.functions.buckets import TIME_BUCKETS, VIEW_BUCKETS
from stridelog.functions.times import duration_label, naive
from stridelog.operators import breakdowns, conversion, dwell, funnel, paths, profiling
from stridelog.operators import sessions as views


def ev(session, second, name="view", **more):
    return {"session_id": session, "created": at(second), "name": name, **more}


# ---- order, null sessions, dwell ----------------------------------------------------------------


def test_null_session_has_no_dwell_and_no_rollup_row(spark):
    events = events_of(spark, ev("a", 0), ev(None, 1), ev("a", 2), ev(None, 3))
    found = {r["id"]: r["duration_sec"] for r in records(dwell.dwell_events(events, SPEC))}
    assert found == {1: 2.0, 2: None, 3: None, 4: None}
    assert only(views.session_rollup(events, SPEC))["num_events"] == 2


def test_null_keys_stay_in_slices_but_not_in_geo(spark):
    events = events_of(spark, ev("a", 0, utm_source="x", geo_country="VN"), ev("b", 1))
    rolled = views.session_rollup(events, SPEC)
    assert {r["utm_source"] for r in records(breakdowns.utm_sources(rolled, SPEC))} == {"x", None}
    assert breakdowns.geo(events).count() == 0


def test_equal_times_follow_the_id(spark):
    rows = [ev("a", 5, n, id=i) for i, n in ((3, "c"), (1, "a"), (2, "b"))]
    events = events_of(spark, *rows)
    assert only(paths.event_sequence(events, SPEC))["event_sequence"] == "a > b > c"


def test_unreadable_times_are_null_and_last(spark):
    created = ["2024-01-01T00:00:00Z", "2024-01-01T00:00:01.250Z", "2024-01-01T07:00:02+07:00",
               "not-a-date", None]
    events = events_of(spark, *({"session_id": "a", "created": c, "name": str(i)}
                                for i, c in enumerate(reversed(created))))
    times = [r["t"] for r in records(events.select("id", naive(F.col("create_ts")).alias("t")), "id")]
    assert times == [None, None, datetime(2024, 1, 1, 0, 0, 2),
                     datetime(2024, 1, 1, 0, 0, 1, 250000), datetime(2024, 1, 1)]
    assert only(paths.event_sequence(events, SPEC))["event_sequence"] == "4 > 3 > 2 > 0 > 1"
    gaps = [r["duration_sec"] for r in records(dwell.dwell_events(events, SPEC), "id")]
    assert gaps == [None, None, None, 0.75, 1.25]


def test_dwell_range_is_open_at_zero_and_closed_at_the_cap(spark):
    seconds = [0, 0, 0.5, 1800.5, 3601]
    events = events_of(spark, *(ev("a", s, page_url="https://a.example/x") for s in seconds))
    kept = [r["duration_sec"] for r in records(dwell.active_events(events, SPEC), "create_ts")]
    assert kept == [0.5, 1800.0]


def test_single_event_session(spark):
    events = events_of(spark, ev("a", 0))
    assert dwell.active_events(events, SPEC).count() == 0
    row = only(views.session_rollup(events, SPEC))
    assert (row["num_events"], row["session_duration_min"]) == (1, 0.0)


# ---- links --------------------------------------------------------------------------------------


def test_links_products_and_home_pages(spark):
    urls = [*SPEC.homepages, "https://a.example/?utm=1", "https://a.example/b#x#y",
            "https://a.example/c-pid-42-pid-7", "https://a.example/du-lich-ha-noi.aspx", None]
    events = events_of(spark, *(ev("a", i, page_url=u) for i, u in enumerate([*urls, "end"])))
    got = records(events, "id")
    assert got[5]["link"] == "https://a.example/b"
    assert got[6]["product_id"] == "42" and got[5]["product_id"] is None
    assert got[7]["destination"] == "ha-noi" and got[6]["destination"] is None
    active = dwell.active_events(events, SPEC)
    assert [r["id"] for r in records(active, "id")] == [5, 6, 7, 8, 9]
    assert dwell.active_events(events, SPEC, exclude_home=False).count() == 9
    assert [r["link"] for r in records(dwell.link_dwell(events, SPEC), "link")] == [
        "https://a.example/?utm=1", "https://a.example/b", "https://a.example/c-pid-42-pid-7",
        "https://a.example/du-lich-ha-noi.aspx"]
    assert homepage_spellings("a.example") == SPEC.homepages


def test_null_link_counts_only_if_named(spark):
    from dataclasses import replace

    rows = [ev("a", 0, page_url="x"), ev("a", 1)]
    assert only(views.session_rollup(events_of(spark, *rows), SPEC))["num_unique_links"] == 1
    spec = replace(SPEC, null_link="None")
    named = events_of(spark, *rows, spec=spec)
    assert only(views.session_rollup(named, spec))["num_unique_links"] == 2


# ---- rollup -------------------------------------------------------------------------------------


def test_first_known_value_in_time_order_and_by_session_name(spark):
    events = events_of(
        spark,
        ev("s2", 0, profile_id="p"), ev("s2", 1, profile_id="p"),
        ev("s2", 3, profile_id="p", utm_source="late"),
        ev("s2", 2, profile_id="p", utm_source="early"),
        ev("s1", 9, profile_id="p", utm_source="other"),
    )
    rolled = views.session_rollup(events, SPEC)
    assert {r["session_id"]: r["utm_source"] for r in records(rolled)} == {
        "s1": "other", "s2": "early"}
    assert only(conversion.profile_attributes(rolled))["utm_source"] == "other"
    assert only(conversion.profile_attributes(rolled, by_time=True))["utm_source"] == "early"


def test_local_date_and_utc_date_of_an_evening_event(spark):
    events = events_of(spark, {"session_id": "a", "created": "2024-01-01T20:00:00Z", "name": "view"})
    row = only(views.session_rollup(events, SPEC))
    assert (row["date_utc"], row["date_local"]) == (date(2024, 1, 1), date(2024, 1, 2))
    assert only(breakdowns.hourly_activity(events, SPEC)) == {
        "date_local": date(2024, 1, 2), "hour_local": 3, "page_views": 1, "intent_events": 0}


def test_all_null_dimension(spark):
    events = events_of(spark, ev("a", 0), ev("b", 0))
    meta = only(profiling.filter_metadata(events))
    assert meta["countries"] == [] and meta["total_sessions"] == 2
    cube = funnel.funnel_rollup(views.session_rollup(events, SPEC), SPEC)
    assert only(cube)["sessions"] == 2
    assert breakdowns.geo(events).count() == 0


def test_a_long_metadata_list_is_whole(spark):
    events = events_of(spark, ev("a", 0, utm_source="s", device_type="pc"))
    many = events.crossJoin(spark.range(20_000).select(F.concat(F.lit("s"), "id").alias("other")))
    many = many.withColumn("utm_source", F.col("other")).drop("other")
    meta = only(profiling.filter_metadata(many))
    assert len(meta["utm_sources"]) == 20_000 and meta["devices"] == ["pc"]
    assert profiling.filter_values(many).filter("dimension = 'utm_sources'").count() == 20_000


@pytest.mark.parametrize("zone", ["UTC", "Asia/Ho_Chi_Minh", "America/New_York"])
def test_the_session_zone_decides_nothing(spark, zone):
    created = [
        "2024-01-01T20:00:00Z", "2024-03-10 02:30:00", "2024-01-01T20:00:00.123456+07:00", "2024-01-02", "1969-12-31T23:59:59.5Z", "no date",
    ]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        events = events_of(spark, *({"id": i, "session_id": f"s{i}", "created": c, "name": "view"} for i, c in enumerate(created)))
        got = records(events.select("id", naive(F.col("create_ts")).cast("string").alias("t"), "hour_local", F.col("date_local").cast("string").alias("d")), "id")
        rolled = records(views.session_rollup(events, SPEC).select("session_id", F.col("started_at").cast("string").alias("s"), F.col("date_utc").cast("string").alias("d")), "session_id")
        hours = sorted(map(str, breakdowns.hourly_activity(events, SPEC).collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [r["t"] for r in got] == [
        "2024-01-01 20:00:00", "2024-03-10 02:30:00", "2024-01-01 13:00:00.123456", "2024-01-02 00:00:00", "1969-12-31 23:59:59.5", None]
    assert [(r["hour_local"], r["d"]) for r in got][:2] == [(3, "2024-01-02"), (9, "2024-03-10")]
    assert [r["d"] for r in rolled] == ["2024-01-01", "2024-03-10", "2024-01-01", "2024-01-02", "1969-12-31", None]
    assert rolled[0]["s"] == "2024-01-01 20:00:00" and len(hours) == 5


# ---- paths --------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "names, path",
    [
        (["p", "p", "q", "p", "p"], "p > q > p"),
        (["p"], "p"),
        (["p", "p", "p"], "p"),
        (["p", None, None, "p"], "p > None > p"),
        ([None, "None"], "None"),
    ],
)
def test_collapsed_path(spark, names, path):
    events = events_of(spark, *(ev("a", i, n) for i, n in enumerate(names)))
    assert only(paths.session_pattern(events, SPEC))["pattern"] == path
    array = F.array(*(F.coalesce(F.lit(n), F.lit("None")) for n in names))
    collapsed = events.limit(1).select(F.array_join(paths.collapse_repeats(array), " > ").alias("p"))
    assert only(collapsed)["p"] == path


def test_keyword_is_a_pattern_unless_literal(spark):
    table = spark.createDataFrame([("View > Cart",), ("view.cart",), (None,)], "pattern string")

    def hits(**how):
        return paths.pattern_search(table, **how).count()

    assert hits(keyword="CART") == 2
    assert hits(keyword="view.c") == 1
    assert hits(keyword="w > c") == 1
    assert hits(keyword=".", literal=True) == 1
    assert hits(keyword=" ") == 3


# ---- funnels ------------------------------------------------------------------------------------


def test_drop_over_a_step_nobody_reached(spark):
    events = events_of(
        spark,
        *(ev(f"s{i}", 0) for i in range(4)),
        ev("s0", 1, "search"), ev("s1", 1, "search"), ev("s0", 2, "order"),
    )
    steps = records(funnel.funnel(events, SPEC), "step_order")
    assert [r["sessions_reaching"] for r in steps] == [4, 2, 0, 1, 0]
    assert [r["drop_from_previous_pct"] for r in steps] == [None, 50.0, 100.0, None, 100.0]
    steps = records(funnel.funnel_of_sessions(views.session_rollup(events, SPEC), SPEC), "step_order")
    assert [r["drop_pct"] for r in steps] == [0.0, 50.0, 100.0, 50.0, 100.0]


def test_empty_slice(spark):
    events = events_of(spark, ev("a", 0, device_type="pc"))
    rolled = FilterSpec(device="none").apply(views.session_rollup(events, SPEC))
    row = only(views.kpis(rolled, SPEC))
    assert (row["sessions"], row["events"], row["cart_rate_pct"]) == (0, 0, 0.0)
    assert [r["sessions"] for r in records(funnel.funnel_of_sessions(rolled, SPEC))] == [0] * 5
    patterns = paths.patterns_of(paths.session_pattern(events, SPEC), rolled)
    assert paths.patterns(patterns).count() == 0
    assert breakdowns.device_share(rolled, SPEC).count() == 0


def test_filter_needs_both_dates_and_rejects_null_dates(spark):
    table = spark.createDataFrame(
        [("pc", "x", "VN", date(2024, 1, 1)), ("pc", "y", "VN", None), ("tv", "x", None, date(2024, 1, 9))],
        "device_type string, utm_source string, geo_country string, date_utc date",
    )
    assert FilterSpec(date_from=date(2024, 1, 1)).apply(table).count() == 3
    both = FilterSpec(date_from=date(2024, 1, 1), date_to=date(2024, 1, 1))
    assert both.apply(table).count() == 1
    assert both.without("date").apply(table).count() == 3
    with pytest.raises(ValueError, match="date_utc"):
        both.apply(table.drop("date_utc"))
    with pytest.raises(ValueError, match="geo_country"):
        breakdowns.utm_performance(table.drop("geo_country"), SPEC, FilterSpec(country="VN"))
    assert FilterSpec(device="pc", source="x", country="VN").apply(table).count() == 1


# ---- breakdowns ---------------------------------------------------------------------------------


def test_hour_with_intent_only(spark):
    events = events_of(spark, ev("a", 0, "cart"), ev("a", 7200, "view"))
    assert breakdowns.hour_of_day(events, SPEC).count() == 2
    assert breakdowns.hour_of_day(events, SPEC, views_only=True).count() == 1
    rates = breakdowns.hour_of_day_rate(breakdowns.hourly_activity(events, SPEC))
    assert [r["intent_rate_pct"] for r in records(rates, "hour_local")] == [None, 0.0]


def test_session_in_two_slices_counts_once_or_twice(spark):
    url = "https://a.example/du-lich-hue.aspx"
    events = events_of(
        spark,
        ev("a", 0, page_url=url, profile_id="p", device_type="pc"),
        ev("a", 1, page_url=url, profile_id="p", device_type="tv"),
    )
    assert only(breakdowns.top_destinations(events, SPEC))["unique_sessions"] == 1
    summed = breakdowns.top_destinations_summed(breakdowns.destinations(events, SPEC))
    assert only(summed)["sessions"] == 2


def test_device_averages_weighted_and_not(spark):
    rows = [ev("x", i, device_type="pc", os_name="A") for i in range(10)]
    rows += [ev(f"y{i}", 0, device_type="pc", os_name="B") for i in range(9)]
    rolled = views.session_rollup(events_of(spark, *rows), SPEC)
    assert only(breakdowns.device_share(rolled, SPEC))["avg_events"] == 1.9
    table = breakdowns.device_os(rolled, SPEC)
    assert only(breakdowns.device_share_unweighted(table))["avg_events"] == 5.5
    systems = {r["os_name"]: r["events"] for r in records(breakdowns.os_breakdown(rolled, SPEC))}
    assert systems == {"A": 10, "B": 9}


# ---- conversion ---------------------------------------------------------------------------------


def test_buckets(spark):
    table = spark.createDataFrame(
        [(v, t) for v, t in zip([0, 1, 2, 3, 4, 5, 9, 10], [None, 0.0, 29.9, 30.0, 60.0, 180.0, 600.0, 0.000001])],
        "v long, t double",
    )
    got = records(table.select(VIEW_BUCKETS.label(F.col("v")).alias("v"), TIME_BUCKETS.label(F.col("t")).alias("t")))
    assert [r["v"] for r in got] == ["0", "1", "2", "3-4", "3-4", "5-9", "5-9", "10+"]
    assert [r["t"] for r in got] == ["0 (no duration)", "0 (no duration)", "<30s", "30-60s",
                                     "1-3min", "3-10min", "10min+", "<30s"]


def pair_rows():
    url = "https://a.example/x-pid-{}"
    return [
        ev("a", 0, "cart", profile_id="p", page_url=url.format(1)),
        ev("a", 10, profile_id="p", page_url=url.format(1), product_name="One"),
        ev("a", 40, profile_id="p", page_url=url.format(1), product_name="Uno"),
        ev("a", 5000, profile_id="q", page_url=url.format(1)),
        ev("a", 5001, "order", profile_id="q", page_url=url.format(1)),
        ev("a", 5002, "order", profile_id="q", page_url=url.format(2)),
        ev("a", 5003, profile_id=None, page_url=url.format(2)),
        ev(None, 5004, profile_id="r", page_url=url.format(3)),
    ]


def test_product_conversion(spark):
    events = events_of(spark, *pair_rows())
    rolled = views.session_rollup(events, SPEC)
    pairs = {(r["profile_id"], r["product_id"]): r
             for r in records(conversion.product_conversion(events, rolled, SPEC))}
    assert set(pairs) == {("p", "1"), ("q", "1"), ("r", "3")}
    first = pairs["p", "1"]
    assert (first["views"], first["total_time"], first["avg_time"]) == (2, 30.0, 30.0)
    assert (first["product_name"], first["intent"], first["booked"]) == ("One", True, False)
    assert (pairs["q", "1"]["intent"], pairs["q", "1"]["booked"]) == (True, True)
    last = pairs["r", "3"]
    assert (last["views"], last["total_time"], last["avg_time"]) == (1, 0.0, None)
    ordered = {(r["profile_id"], r["product_id"]): r["intent"] for r in records(
        conversion.product_conversion(events, rolled, SPEC, ordered_intent=True))}
    assert ordered == {("p", "1"): False, ("q", "1"): True, ("r", "3"): False}


def test_renamed_product(spark):
    pairs = spark.createDataFrame(
        [("p", "1", 2, 1.0, "One", True, False), ("q", "1", 3, 1.0, "Uno", False, False),
         ("r", "1", 9, 1.0, None, False, False)],
        "profile_id string, product_id string, views long, total_time double, product_name string, "
        "intent boolean, booked boolean",
    )
    row = only(conversion.top_products(pairs))
    assert (row["product_name"], row["total_views"], row["unique_users"]) == ("Uno", 14, 3)
    assert row["conv_pct"] == 33.33
    by_name = records(conversion.top_products(pairs, by_name=True), "product_name")
    assert [(r["product_name"], r["total_views"]) for r in by_name] == [("One", 2), ("Uno", 3)]


def test_matrix_hides_only_empty_columns_when_shown(spark):
    pairs = spark.createDataFrame(
        [(1, 0.0, True), (1, 10.0, False), (10, 700.0, True)],
        "views long, total_time double, intent boolean",
    )
    matrix = conversion.conversion_matrix(pairs)
    rows = records(matrix, "bucket_order")
    assert [r["views_bucket"] for r in rows] == ["1", "10+"]
    assert rows[0]["t_none"] == 100.0 and rows[0]["t_lt30s"] == 0.0 and rows[0]["t_10min_up"] is None
    assert conversion.shown_columns(matrix).columns == [
        "bucket_order", "views_bucket", "t_none", "t_lt30s", "t_10min_up"]


# ---- labels, configuration ----------------------------------------------------------------------


def test_duration_labels(spark):
    table = spark.createDataFrame([(None,), (12.34,), (1800.0,), (1801.4,)], "s double")
    got = [r["l"] for r in records(table.select(duration_label(F.col("s"), 1800).alias("l")))]
    assert got == ["— (event cuối / không đo được)", "12.3s", "1800.0s", "1801s (> 30p, outlier)"]
    over = table.select(duration_label(F.col("s"), 600).alias("l")).filter("l LIKE '%outlier%'")
    assert {r["l"] for r in records(over)} == {"1800s (> 10p, outlier)", "1801s (> 10p, outlier)"}


def test_duration_labels_round_like_printf(spark):
    """Values half way between two labels: the stored double decides, an exact tie goes to the even digit."""
    us = [*range(50_000, 40_000_000, 100_000), *range(1_790_050_000, 1_802_000_000, 50_000), 0, 1, 49_999, 1_800_000_001]
    table = spark.createDataFrame([(u,) for u in us], "us bigint").withColumn("s", F.col("us") / F.lit(1_000_000.0))
    got = {r["us"]: r["l"] for r in records(table.select("us", duration_label(F.col("s"), 1800).alias("l")))}
    wanted = {u: "%.0fs (> 30p, outlier)" % (u / 1e6) if u > 1_800_000_000 else "%.1fs" % (u / 1e6) for u in us}
    assert got == wanted
    assert [got[u] for u in (250_000, 350_000, 1_950_000, 1_800_500_000)] == ["0.2s", "0.3s", "1.9s", "1800s (> 30p, outlier)"]


def test_timeline(spark):
    events = events_of(spark, ev("a", 0), ev("a", 2000), ev("a", 2001.5, None), ev("b", 0))
    rows = records(views.session_timeline(events, SPEC, "a"), "step")
    assert [r["step_label"] for r in rows] == ["1. view", "2. view", "3. None"]
    assert [r["duration_plot"] for r in rows] == [0.0, 1.5, 0.0]
    totals = only(views.session_timeline_totals(events, SPEC, "a"))
    assert (totals["events"], totals["measured_sec"]) == (3, 1801.5)
    lone = only(views.session_timeline_totals(events, SPEC, "b"))
    assert (lone["total_min"], lone["measured_sec"]) == (0.0, 0.0)


def test_missing_columns(spark):
    raw = raw_events(spark, ev("a", 0)).drop("geo_city", "product_name")
    events = canonical_events(raw, SPEC)
    assert dict(events.dtypes)["geo_city"] == "string"
    with pytest.raises(ValueError, match="session_id"):
        canonical_events(raw.drop("session_id"), SPEC)


def test_travel_configuration():
    spec = travel_spec("shop.example")
    assert [s.had for s in spec.steps] == [
        "had_page_view", "had_search", "had_add_to_cart", "had_order", "had_success"]
    assert spec.steps[0].reached == "reached_Page_View"
    assert len(spec.homepages) == 4
