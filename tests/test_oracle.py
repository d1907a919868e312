"""Every named query against its SQL in an independent engine."""

from __future__ import annotations

import os

import pytest
from compare import connect, differences

from __spark_entry__ import entry, oracle_sql, queries
from stridelog.plans.queries import QUERIES

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(oracle_sql()) <= set(queries())


def test_entry_runs(spark):
    assert [r["step"] for r in entry(spark).orderBy("step_order").collect()] == [
        "view",
        "click",
        "signup",
        "purchase",
    ]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, duck, name):
    assert differences(queries()[name](spark, FOLDER), duck, oracle_sql()[name]) == []
