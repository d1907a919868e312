"""Distributed order statistics against pandas."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stridelog.operators.statistics import correlations, cumulative_counts, percentiles


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        key = rng.choice(["hot", "hot", "hot", "b", "c"])
        value = rng.choice([5, 1 << 20, (1 << 20) - 1, rng.randrange(1_800_000_000), rng.randrange(99)])
        rows.append((key, value))
    return rows + [("one", 17), ("none", None)]


def test_percentiles(spark, sample):
    df = spark.createDataFrame(sample, "k string, v long").repartition(7)
    wanted = {"p0": 0.0, "median": 0.5, "p90": 0.9, "p100": 1.0}
    got = {r["k"]: r for r in percentiles(df, ["k"], "v", wanted).collect()}
    frame = pd.DataFrame(sample, columns=["k", "v"]).dropna()
    assert set(got) == set(frame.k)
    for key, group in frame.groupby("k"):
        for name, fraction in wanted.items():
            assert got[key][name] == pytest.approx(group.v.quantile(fraction), rel=1e-12)


def test_cumulative_counts_over_three_levels(spark):
    values = [0.0, 1.5, 1.5, 7.0, 2.0**20, 2.0**20 + 0.5, 2.0**40, 2.0**40, 2.0**45 + 3]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    counts = df.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    got = {r["v"]: r["before"] for r in cumulative_counts(counts, [], "v").collect()}
    assert got == {v: sum(w < v for w in values) for v in values}


def test_correlations(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(2000):
        views = rng.choice([1, 1, 1, 2, 3, 8])
        total = rng.choice([0.0, 0.0, round(rng.random() * 4000, 6)])
        average = total / views if total else None
        rows.append((views, total, average, rng.random() < 0.2 + 0.05 * views))
    df = spark.createDataFrame(rows, "a long, b double, c double, y boolean")
    frame = pd.DataFrame(rows, columns=["a", "b", "c", "y"]).fillna(0)
    got = {r["metric"]: r for r in correlations(df, ["a", "b", "c"], "y", digits=9).collect()}
    y = frame.y.astype(int)
    for m in "abc":
        x = frame[m].astype(float)
        assert got[m]["pearson_r"] == pytest.approx(x.corr(y), abs=1e-9)
        assert got[m]["spearman_r"] == pytest.approx(x.rank().corr(y.rank()), abs=1e-9)


def test_constant_has_no_correlation(spark):
    df = spark.createDataFrame([(1, 2.0, False), (1, 3.0, False)], "a long, b double, y boolean")
    for row in correlations(df, ["a", "b"], "y").collect():
        assert row["pearson_r"] is None and row["spearman_r"] is None
    df = spark.createDataFrame([(1, 0.1, True), (1, 0.1, False), (1, 0.1, False)], "a long, b double, y boolean")
    for row in correlations(df, ["a", "b"], "y").collect():
        assert row["pearson_r"] is None and row["spearman_r"] is None
