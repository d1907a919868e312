"""The queries that have SQL against an independent engine."""

from __future__ import annotations

import pytest
from compare import connect, differences

from stridelog.llm.oracles import ORACLES
from stridelog.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, name):
    folder = "/root/testdata/sf0.01"
    assert differences(QUERIES[name](spark, folder), connect(folder), ORACLES[name]) == []
