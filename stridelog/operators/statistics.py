"""Exact order statistics over many partitions: cumulative counts, percentiles, correlations.

The built-in exact `percentile` and a ranking window both bring all distinct values of a group into
one task. Here a group is first reduced to (value, count) rows, and positions are added up over three
levels of value ranges, so that no window sees more than about a million of them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A fine range is 2**20 wide, a coarse one 2**40: a second and 13 days in microseconds.
RANGE_BITS = 20


def value_counts(df: DataFrame, keys: Sequence[str], value: str, **sums) -> DataFrame:
    """One row per (keys, value): `n`, the number of rows, and the given sums."""
    extra = [expr.alias(name) for name, expr in sums.items()]
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), *extra)


def _running(order: str, within: Sequence[str]) -> Column:
    """Sum of `n` over the rows before this one."""
    window = (
        Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return F.coalesce(F.sum("n").over(window), F.lit(0))


def _range_of(value: str, bits: int) -> Column:
    return F.shiftright(F.floor(value).cast("long"), bits)


def cumulative_counts(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Add `before`: the rows of the same group with a smaller value.

    `counts` holds distinct non-negative values and their counts `n`. Three levels: within a fine
    range, among the fine ranges of a coarse one, among the coarse ranges.
    """
    keys = list(keys)
    by_coarse, by_fine = [*keys, "_coarse"], [*keys, "_coarse", "_fine"]
    counts = counts.withColumns(
        {"_fine": _range_of(value, RANGE_BITS), "_coarse": _range_of(value, 2 * RANGE_BITS)}
    )
    fine = counts.groupBy(*by_fine).agg(F.sum("n").alias("n"))
    coarse = fine.groupBy(*by_coarse).agg(F.sum("n").alias("n"))
    coarse = coarse.select(*by_coarse, _running("_coarse", keys).alias("_in_coarse"))
    fine = fine.select(*by_fine, _running("_fine", by_coarse).alias("_in_fine"))
    return (
        counts.withColumn("before", _running(value, by_fine))
        .join(fine.join(coarse, by_coarse), by_fine)
        .withColumn("before", F.col("before") + F.col("_in_fine") + F.col("_in_coarse"))
        .drop("_fine", "_coarse", "_in_fine", "_in_coarse")
    )


def percentiles(
    df: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, float]
) -> DataFrame:
    """Exact percentiles with linear interpolation per group, as doubles.

    For values in [0, 2**40), such as capped microseconds. `wanted` maps output names to fractions.
    Only the few ranges that hold a wanted position are looked at value by value.
    """
    keys = list(keys)
    by_fine = [*keys, "_fine"]
    counts = value_counts(df.filter(F.col(value).isNotNull()), keys, value)
    counts = counts.withColumn("_fine", _range_of(value, RANGE_BITS))
    total = F.sum("n").over(Window.partitionBy(*keys))
    fine = (
        counts.groupBy(*by_fine)
        .agg(F.sum("n").alias("n"))
        .select(
            *by_fine,
            F.col("n").alias("_size"),
            _running("_fine", keys).alias("_base"),
            total.alias("_total"),
        )
    )

    def position(fraction: float) -> Column:
        return F.lit(float(fraction)) * (F.col("_total") - 1)

    ends = {
        f"_{name}_{end}": rounded(position(fraction))
        for name, fraction in wanted.items()
        for end, rounded in (("lo", F.floor), ("hi", F.ceil))
    }

    def holds(start: Column, size: str, rank: Column) -> Column:
        return (start <= rank) & (rank < start + F.col(size))

    needed = F.lit(False)
    for rank in ends.values():
        needed = needed | holds(F.col("_base"), "_size", rank)
    placed = counts.join(fine.filter(needed), by_fine).withColumn(
        "before", F.col("_base") + _running(value, by_fine)
    )
    picked = placed.groupBy(*keys).agg(
        F.max("_total").alias("_total"),  # the same in every row of a group
        *(
            F.max(F.when(holds(F.col("before"), "n", rank), F.col(value))).alias(end)
            for end, rank in ends.items()
        ),
    )
    return picked.select(
        *keys,
        *(
            (
                F.col(f"_{name}_lo")
                + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo"))
                * (position(fraction) - F.floor(position(fraction)))
            ).alias(name)
            for name, fraction in wanted.items()
        ),
    )


# Metrics are ranked on a grid this much finer than one unit, so that a range of values in seconds
# spans four milliseconds.
RANK_SCALE = 256_000_000.0


def correlations(df: DataFrame, metrics: Sequence[str], flag: str, digits: int = 4) -> DataFrame:
    """Pearson and Spearman correlation of each non-negative metric with a flag; nulls count as 0.

    (metric, pearson_r, spearman_r). A constant metric or flag has no correlation: null. Both come
    from one table of distinct values. The average ranks of the flag are a linear function of the
    flag, so only the metric needs ranking.
    """
    long = df.select(
        F.col(flag).cast("long").alias("y"),
        *(F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m) for m in metrics),
    ).unpivot(["y"], list(metrics), "metric", "x")
    counts = value_counts(long, ["metric"], "x", y=F.sum("y"))
    counts = counts.withColumn("_scaled", F.col("x") * RANK_SCALE)
    ranked = cumulative_counts(counts, ["metric"], "_scaled").withColumn(
        "rank", F.col("before") + (F.col("n") + 1) / F.lit(2.0)
    )
    n, x, y, rank = (F.col(c) for c in ("n", "x", "y", "rank"))
    sums = ranked.groupBy("metric").agg(
        F.sum(n).cast("double").alias("rows"),
        F.sum(y).cast("double").alias("ones"),
        F.count(F.lit(1)).alias("values"),
        *(
            total.alias(f"{of}_{name}")
            for of, v in (("x", x), ("rank", rank))
            for name, total in (
                ("sum", F.sum(n * v)),
                ("square", F.sum(n * v * v)),
                ("ones", F.sum(y * v)),
            )
        ),
    )
    rows, ones = F.col("rows"), F.col("ones")

    def correlation(of: str) -> Column:
        total, square, with_flag = (F.col(f"{of}_{k}") for k in ("sum", "square", "ones"))
        covariance = with_flag - total * ones / rows
        variance = F.when(F.col("values") > 1, F.greatest(square - total * total / rows, F.lit(0.0)))
        flag_variance = ones - ones * ones / rows
        return F.round(F.try_divide(covariance, F.sqrt(variance) * F.sqrt(flag_variance)), digits)

    return sums.select(
        "metric", correlation("x").alias("pearson_r"), correlation("rank").alias("spearman_r")
    )
