"""Rows that cannot be used, and events that arrive as a stream."""

from __future__ import annotations

import pytest
from fixtures import COLUMNS, SCHEMA, SPEC, at, raw_events, records
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stridelog.sources import quarantine
from stridelog.streaming import rollups


def test_quarantine_of_a_file(spark, tmp_path):
    """Clean and quarantined rows are all rows; a broken line is kept as it was read."""
    good = '1,s1,u1,view,t,2024-01-01 10:00:00,https://a.example/,"a, ""b""",x,pc,os,VN,c'
    lines = [
        ",".join(COLUMNS),
        good,
        "2,s1,u1,view,t,not a time,https://a.example/,p,x,pc,os,VN,c",
        "3,s1,u1,view,t,,https://a.example/,p,x,pc,os,VN,c",
        "x4,s1,u1,view,t,2024-01-01 10:00:00,https://a.example/,p,x,pc,os,VN,c",
        "5,s1,u1",
        "6,s1,u1,view,t,2024-01-01 10:00:00,https://a.example/,p,x,pc,os,VN,c,more,fields",
        ",s1,u1,view,t,2024-01-01T10:00:00Z,https://a.example/,p,x,pc,os,VN,c",
    ]
    (tmp_path / "events.csv").write_text("\n".join(lines) + "\n")
    read = quarantine.read_csv(spark, str(tmp_path / "events.csv"), StructType.fromDDL(SCHEMA))
    clean, bad = quarantine.split(read, SPEC)
    assert clean.columns == COLUMNS
    assert [(r.id, r.product_name) for r in clean.collect()] == [(1, 'a, "b"')]
    assert clean.count() + bad.count() == len(lines) - 1
    reasons = {r.reason: r.rows for r in quarantine.counts(bad).collect()}
    assert reasons == {"broken line": 3, "no id": 2, "no time": 2, "unreadable created": 1}
    broken = {r[quarantine.CORRUPT] for r in bad.collect()} - {None}
    assert broken == set(lines[4:7])


def test_quarantine_of_a_table(spark):
    raw = raw_events(spark, {"created": at(0), "name": "view"}, {"created": "soon"}, {"created": None}, {"id": None, "created": at(1)})
    clean, bad = quarantine.split(raw, SPEC)
    assert [r.id for r in clean.collect()] == [1]
    key = lambda r: tuple(map(str, r))
    assert sorted(clean.unionByName(bad.drop("reasons")).collect(), key=key) == sorted(raw.collect(), key=key)
    assert {r.reason: r.rows for r in quarantine.counts(bad).collect()} == {"unreadable created": 1, "no time": 1, "no id": 1}
    assert quarantine.counts(quarantine.split(raw.limit(0), SPEC)[1]).count() == 0


# ---- streams ------------------------------------------------------------------------------------

HOUR = 3600


def arrivals():
    """Three deliveries: events of a day, then late ones, then the next hours; a last one far too late."""
    first = [{"session_id": f"s{i % 5}", "name": ("view", "search", "cart")[i % 3], "created": at(i * 60), "utm_source": None if i < 7 else f"u{i % 2}", "device_type": "pc"} for i in range(60)]
    second = [{"session_id": "s1", "name": "done", "created": at(20 * 60 + 30), "device_type": "pc"}, {"session_id": "new", "name": "view", "created": at(45 * 60)}, {"session_id": None, "name": "view", "created": at(50 * 60)}]
    second += [{"session_id": "s2", "name": "view", "created": at(2.5 * HOUR)}, {"session_id": "s2", "name": "order", "created": at(2.5 * HOUR + 60)}, {"session_id": "s2", "name": None, "created": None}]
    third = [{"session_id": "s2", "name": "view", "created": at(9 * HOUR)}, {"session_id": "s3", "name": "order", "created": at(9 * HOUR + 5)}]
    parts, n = [], 0
    for part in (first, second, third):
        parts.append([{"id": n + i + 1, **r} for i, r in enumerate(part)])
        n += len(part)
    return parts


@pytest.mark.parametrize("what", ["sessions", "hours"])
def test_stream_equals_the_batch(spark, tmp_path, what):
    """Closed windows are the rows of the batch, over late events and a restart after every delivery."""
    make = {"sessions": rollups.session_windows, "hours": rollups.hourly_windows}[what]
    source, out, checkpoint = (str(tmp_path / d) for d in ("in", "out", "checkpoint"))
    parts = arrivals()
    for part in parts:
        raw_events(spark, *part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(raw_events(spark, *part).schema).parquet(source)
        query = rollups.append_to(make(stream, SPEC), out, checkpoint)
        query.awaitTermination(120)
        assert query.exception() is None
    # Two hours behind the newest event nothing more can come; the windows of the last delivery are open.
    closed = [r for part in parts[:2] for r in part]
    want = make(raw_events(spark, *closed), SPEC)
    got = spark.read.parquet(out)
    assert got.columns == want.columns
    assert records(got, *got.columns[:3]) == records(want, *got.columns[:3])
    assert got.count() >= 2

    # An event whose windows are closed and written changes nothing any more.
    raw_events(spark, {"id": 999, "session_id": "s1", "name": "done", "created": at(30)}).write.mode("append").parquet(source)
    query = rollups.append_to(make(spark.readStream.schema(want_schema(spark)).parquet(source), SPEC), out, checkpoint)
    query.awaitTermination(120)
    assert records(spark.read.parquet(out), *got.columns[:3]) == records(want, *got.columns[:3])


def want_schema(spark):
    return raw_events(spark, {"id": 1}).schema


def test_session_windows_part_at_silence(spark):
    rows = [{"session_id": "s", "name": "view", "created": at(t)} for t in (0, 600, 600 + 1799, 9000)]
    got = records(rollups.session_windows(raw_events(spark, *rows), SPEC).select("num_events", F.col("session_duration_min")), "num_events")
    assert [r["num_events"] for r in got] == [1, 3]
