"""Rows that cannot be used, kept beside the others with the reasons instead of being lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.times import parsed_time
from ..session import written
from ..spec import EventSpec

#: The line as it was read, of a CSV row that has too few or too many fields or one of the wrong kind.
CORRUPT = "_corrupt_record"
REASONS = "reasons"


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType, multi_line: bool = False) -> DataFrame:
    """CSV with a header as `sources.readers` reads it, and the column `_corrupt_record`.

    The rows are stored once: Spark cannot tell the broken ones while it reads some columns only.
    """
    kept = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    options = {"header": True, "multiLine": multi_line, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return written(spark.read.schema(kept).options(**options).csv(path), "csv-rows")


def split(raw: DataFrame, spec: EventSpec) -> tuple[DataFrame, DataFrame]:
    """(the usable rows, the others with the array column `reasons`); together they are all rows.

    Reasons: `broken line`, `no id`, `no time`, and `unreadable <column>` for a time that is there but is not one.
    A usable row has an id and a time of its creation; the other times may be missing, but not unreadable.
    """
    times = [c for c in ("created", "inserted", "session_start") if spec.columns.get(c) in raw.columns]

    def reason(condition, text: str):
        return F.when(condition, F.lit(text))

    found = []
    if CORRUPT in raw.columns:
        found.append(reason(F.col(CORRUPT).isNotNull(), "broken line"))
    found.append(reason(raw[spec.columns["id"]].isNull(), "no id"))
    found.append(reason(raw[spec.columns["created"]].isNull(), "no time"))
    for logical in times:
        column = spec.columns[logical]
        found.append(reason(raw[column].isNotNull() & parsed_time(raw, column).isNull(), f"unreadable {column}"))
    told = raw.withColumn(REASONS, F.array_compact(F.array(*found)))
    return told.filter(F.size(REASONS) == 0).drop(REASONS, CORRUPT), told.filter(F.size(REASONS) > 0)


def counts(quarantined: DataFrame) -> DataFrame:
    """Rows per reason; a row with several reasons counts for each."""
    return quarantined.select(F.explode(REASONS).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))
