"""The router gives the rows of the events, from the smallest table that has them."""

from __future__ import annotations

from datetime import date

import pytest

from stridelog import FilterSpec, canonical_events
from stridelog.plans import pipeline
from stridelog.plans.router import Router
from stridelog.sources.demo import CLICKS_SPEC, clicks
from stridelog.sources import generations

DAYS = {"date_from": date(2024, 1, 3), "date_to": date(2024, 1, 20)}
SLICES = [
    FilterSpec(), FilterSpec(device="mobile"), FilterSpec(source="src1"), FilterSpec(country="US"), FilterSpec(**DAYS), FilterSpec(device="pc", source="src2", country="VN", **DAYS),
]
REACHED = [s.reached for s in CLICKS_SPEC.steps]


@pytest.fixture(scope="module")
def routers(spark, tmp_path_factory):
    events = canonical_events(clicks(spark, "/root/testdata/sf0.001"), CLICKS_SPEC).cache()
    made = pipeline.publish_aggregates(events, CLICKS_SPEC, str(tmp_path_factory.mktemp("stored")))
    nothing = generations.Generation(made.folder, 0, made.data, {})
    return Router(spark, made, CLICKS_SPEC, events), Router(spark, nothing, CLICKS_SPEC, events)


@pytest.mark.parametrize("filters", SLICES)
@pytest.mark.parametrize("by", [(), ("device_type",), ("date",), ("utm_source", "geo_country")])
def test_same_rows_as_from_events(routers, filters, by):
    stored, plain = routers
    for measures in (["sessions", *REACHED], ["sessions", "events", "users"]):
        assert plain.choose(measures, filters, by).name == "events"
        assert stored.choose(measures, filters, by).name != "events"
        rows = [sorted(map(tuple, r.answer(measures, filters, by).collect()), key=repr) for r in routers]
        assert rows[0] == rows[1]


def test_the_smallest_table_is_read(routers):
    stored, plain = routers
    names = lambda *a: (stored.choose(*a).name, stored.choose(*a).keys)
    assert names(["sessions"]) == ("funnel_grains", ())
    assert names(["sessions"], FilterSpec(device="pc")) == ("funnel_grains", ("device_type",))
    assert names(REACHED, FilterSpec(**DAYS)) == ("funnel_grains", ("date",))
    assert names(["sessions"], FilterSpec(device="pc", source="a"))[0] in ("funnel_rollup", "visitor_cube")
    assert names(["users_near"], FilterSpec(country="US"))[0] == "visitor_cube"
    assert names(["users"], FilterSpec(country="US"))[0] == "sessions"
    with pytest.raises(ValueError, match="users_near"):
        plain.choose(["users_near"])


def test_estimated_users(routers):
    stored, _ = routers
    for filters in SLICES:
        near, exact = (stored.answer([m], filters).first()[0] for m in ("users_near", "users"))
        assert abs(near - exact) * 100 <= 2 * exact
