"""Labelled buckets over half-open ranges, with a sort order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BucketSpec:
    """`bounds[i] <= value < bounds[i+1]` gets `labels[i]`; the last one is open-ended.

    `aliases` are column-safe names of the same buckets. A null value counts as `null_as`.
    """

    labels: tuple[str, ...]
    bounds: tuple[float, ...]
    aliases: tuple[str, ...]
    null_as: float = 0.0

    def pick(self, value: Column, results: tuple) -> Column:
        """The result that belongs to the value's bucket."""
        value = F.coalesce(value, F.lit(self.null_as))
        choice = F.lit(results[0])
        for bound, result in zip(self.bounds[1:], results[1:]):
            choice = F.when(value >= bound, F.lit(result)).otherwise(choice)
        return choice

    def label(self, value: Column) -> Column:
        return self.pick(value, self.labels)

    def order(self, value: Column) -> Column:
        return self.pick(value, tuple(range(len(self.labels))))


# The view-count and dwell-time buckets. A product without a counted view has its own.
VIEW_BUCKETS = BucketSpec(
    labels=("0", "1", "2", "3-4", "5-9", "10+"),
    bounds=(0, 1, 2, 3, 5, 10),
    aliases=("v_0", "v_1", "v_2", "v_3_4", "v_5_9", "v_10_up"),
)
TIME_BUCKETS = BucketSpec(
    labels=("0 (no duration)", "<30s", "30-60s", "1-3min", "3-10min", "10min+"),
    bounds=(0, 1e-6, 30, 60, 180, 600),  # the smallest measurable time is one microsecond
    aliases=("t_none", "t_lt30s", "t_30_60s", "t_1_3min", "t_3_10min", "t_10min_up"),
)
