"""Reading event and aggregate tables from any Hadoop file system."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_table(
    spark: SparkSession,
    path: str | list[str],
    fmt: str = "parquet",
    schema: StructType | str | None = None,
    merge_schema: bool = False,
    base_path: str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Parquet or CSV at a path, a list of paths or a glob, local or remote, as one table.

    CSV needs a schema: identifiers must not be read as numbers because a sample looked like some.
    `multi_line` reads CSV whose quoted fields may hold line breaks; such a file is one task, while
    other CSV files are split.
    """
    reader = spark.read
    if base_path:
        reader = reader.option("basePath", base_path)
    if fmt == "csv":
        if schema is None:
            raise ValueError("a CSV source needs an explicit schema")
        # Quotes inside a quoted field are doubled, as RFC 4180 has it.
        options = {"header": True, "multiLine": multi_line, "quote": '"', "escape": '"'}
        return reader.schema(schema).options(**options).csv(path)
    if fmt != "parquet":
        raise ValueError(f"unknown format {fmt!r}: use 'parquet' or 'csv'")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.option("mergeSchema", merge_schema).parquet(*([path] if isinstance(path, str) else path))


def read_first(
    spark: SparkSession,
    candidates: Iterable[tuple[str, str]],
    schema: StructType | str | None = None,
) -> DataFrame:
    """The first existing source among (path, format) candidates; an error names them all."""
    tried = []
    for path, fmt in candidates:
        try:
            return read_table(spark, path, fmt, schema)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            tried.append(path)
    raise FileNotFoundError(f"no event source found, looked for: {tried}")
