"""Writing tables, with the row count taken while they are written."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Written:
    """A stored table: its rows, and the bytes of its files."""

    rows: int
    bytes: int


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Iterable[str] = (),
    sort_by: Iterable[str] = (),
    mode: str = "error",
    rebalance: bool = True,
    bloom_by: Iterable[str] = (),
    dynamic: bool = False,
    **options,
) -> int:
    """Write `df` as zstd Parquet, CSV with a header, or JSON, and return the number of rows.

    With `partition_by`, rows are first rebalanced on those columns, unless they are laid out already: a
    small partition gets one file, and a large one is split over several tasks. `sort_by` orders the rows of each file, so
    that a filter on those columns skips most row groups; `bloom_by` adds bloom filters of columns, which
    skip row groups where the range of values does not. `dynamic` with mode "overwrite" replaces only
    the partitions that `df` has rows for. Further options are those of the format.
    """
    seen = Observation()
    partition_by, sort_by = list(partition_by), list(sort_by)
    df = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    if partition_by and rebalance:
        df = df.hint("rebalance", *(F.col(c) for c in partition_by))
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    writer = df.write.mode(mode).options(**options)
    if dynamic:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    for column in bloom_by:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "parquet":
        writer.option("compression", "zstd").parquet(path)
    elif fmt == "csv":
        writer.options(header=True, quote='"', escape='"').csv(path)
    elif fmt == "json":
        writer.option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"unknown format {fmt!r}: use 'parquet', 'csv' or 'json'")
    return seen.get["rows"]


def write_bundle(
    tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet", mode: str = "error"
) -> dict[str, int]:
    """Write each table of a report to its own directory; rows per table."""
    return {
        name: write_table(df, f"{folder.rstrip('/')}/{name}", fmt, mode=mode)
        for name, df in tables.items()
    }


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Size of the data files under `path`. Their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()["bytes"]
