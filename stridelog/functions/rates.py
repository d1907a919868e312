"""Ratios that stay null, instead of failing, on a zero base."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent(part: Column, whole: Column, digits: int | None = None) -> Column:
    value = ratio(part, whole) * 100
    return value if digits is None else F.round(value, digits)


def count_true(flag: Column) -> Column:
    """How many rows have the flag; 0, never null, on no rows."""
    return F.count(F.when(flag, F.lit(1)))
