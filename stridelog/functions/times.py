"""Timestamps, local time and dwell ranges.

A time without a zone is a UTC time here. Spark's casts between the two kinds of timestamps read the
zone of the session, so none is used: the same rows come out under any session zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
#: The start of 1970 without a zone; arithmetic on it is in UTC whatever the session's zone.
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
#: A zone, or an offset, behind the minutes or seconds of a time.
ZONED = r":\d{2}(\.\d*)?\s*[A-Za-z+-]"


def parsed_time(df: DataFrame, column: str) -> Column:
    """Column `column` as a timestamp; text that is not one becomes null, row by row.

    A zone in the text counts; a text or a column without a zone is in UTC.
    """
    kind = df.schema[column].dataType.typeName()
    value = df[column]
    if kind == "string":
        return F.when(value.rlike(ZONED), F.try_to_timestamp(value)).otherwise(
            utc_instant(value.try_cast("timestamp_ntz"))
        )
    if kind == "timestamp":
        return value
    return utc_instant(value.cast("timestamp_ntz"))


def utc_instant(clock: Column) -> Column:
    """The moment at which the UTC wall clock shows `clock`, a timestamp without a zone."""
    # A difference of two times would read them in the zone of the session.
    days = F.unix_date(F.to_date(clock)).cast("long")
    micros = (F.extract(F.lit("SECOND"), clock) * 1_000_000).cast("long")
    minutes = (F.hour(clock) * 60 + F.minute(clock)).cast("long")
    return F.timestamp_micros(days * DAY_US + minutes * 60_000_000 + micros)


def naive(ts: Column) -> Column:
    """The UTC wall clock of `ts`, without a zone."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(ts), F.expr(EPOCH))


def local_time(ts: Column, offset_hours: int) -> Column:
    """The wall clock at a place `offset_hours` ahead of UTC."""
    return naive(ts) + F.make_dt_interval(hours=F.lit(offset_hours))


def _local_us(ts: Column, offset_hours: int) -> Column:
    return F.unix_micros(ts) + F.lit(offset_hours * HOUR_US)


def local_hour(ts: Column, offset_hours: int) -> Column:
    in_day = F.pmod(_local_us(ts, offset_hours), F.lit(DAY_US))
    return ((in_day - in_day % HOUR_US) / HOUR_US).cast("int")


def local_date(ts: Column, offset_hours: int) -> Column:
    us = _local_us(ts, offset_hours)
    return F.date_from_unix_date(((us - F.pmod(us, F.lit(DAY_US))) / DAY_US).cast("int"))


def elapsed_us(start: Column, end: Column) -> Column:
    """Whole microseconds between two timestamps, exact."""
    return F.unix_micros(end) - F.unix_micros(start)


def seconds(us: Column) -> Column:
    return us / F.lit(1_000_000.0)


def valid_dwell(us: Column, cap_us: int) -> Column:
    """`us` where it lies in (0, cap], else null."""
    return F.when((us > 0) & (us <= cap_us), us)


def duration_label(secs: Column, cap_seconds: int) -> Column:
    """A dwell time as text: missing, an outlier above the cap, or seconds."""
    # The texts of the two cases; "p" stands for minutes.
    cap = f"{cap_seconds // 60}p" if cap_seconds % 60 == 0 else f"{cap_seconds}s"

    # As SQL's printf, a pattern rounds the value that is stored, ties to even; format_string rounds its shortest decimal up.
    def rounded(pattern: str) -> Column:
        return F.call_function("format_number", secs, F.lit(pattern))

    return (
        F.when(secs.isNull(), F.lit("— (event cuối / không đo được)"))
        .when(secs > cap_seconds, F.concat(rounded("0"), F.lit(f"s (> {cap}, outlier)")))
        .otherwise(F.concat(rounded("0.0"), F.lit("s")))
    )
