"""Text repair on every kind of damage, against a per-value implementation."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stridelog.operators.cleaning import repair_text

CLEAN = [
    "Du lịch Hà Nội – 3 ngày 2 đêm", "Tour Đà Nẵng “giá tốt”", "crème brûlée, déjà vu", "日本の旅行",
    "plain ascii", "", "line\nbreak \\ \"quoted\" \t tab", "€100 – ‘sale’", "naïve Ã© mark", "😀 trip",
    "_x005_ not an escape", "x" * 5000 + " Huế",
]


def latin1(text: str) -> str:
    return text.encode("utf-8").decode("latin-1")


def cp1252(text: str) -> str:
    """Misread as Windows-1252, the five undefined bytes kept; control characters escaped."""
    out = []
    for byte in text.encode("utf-8"):
        try:
            char = bytes([byte]).decode("cp1252")
        except UnicodeDecodeError:
            char = chr(byte)
        out.append(f"_x{ord(char):04X}_" if 0x80 <= ord(char) < 0xA0 else char)
    return "".join(out)


def expected(text: str | None, passes: int = 3) -> str | None:
    import re

    if text is None:
        return None
    text = re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)
    for _ in range(passes):
        try:
            raw = b"".join(
                bytes([ord(c)]) if ord(c) < 256 else c.encode("cp1252") for c in text
            )
            text = raw.decode("utf-8")
        except UnicodeError:
            break
    return text


def repair(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["t"] for r in repair_text(df).orderBy("i").collect()]


@pytest.mark.parametrize("damage", [lambda t: t, latin1, cp1252, lambda t: latin1(latin1(t))],
                         ids=["none", "latin1", "cp1252", "twice"])
def test_repair(spark, damage):
    values = [damage(t) for t in CLEAN] + [None]
    got = repair(spark, values)
    assert got == [expected(v) for v in values]
    kept = [c for c in CLEAN if expected(c) == c]
    assert len(kept) >= len(CLEAN) - 2
    for clean, fixed in zip(CLEAN, got):
        if clean in kept:
            assert fixed == clean


def test_only_text_columns_and_only_the_chosen_ones(spark):
    df = spark.createDataFrame([(1, latin1("Huế"), latin1("Huế"))], "n int, a string, `b.c` string")
    assert tuple(repair_text(df).first()) == (1, "Huế", "Huế")
    assert tuple(repair_text(df, ["a"]).first()) == (1, "Huế", latin1("Huế"))
    assert tuple(repair_text(df, []).first()) == tuple(df.first())


def test_large_text_with_an_escape(spark):
    df = spark.range(1).select(F.concat(F.repeat(F.lit("abcdefghij"), 300_000), F.lit("_x0041_")).alias("t"))
    row = repair_text(df).select(F.length("t").alias("n"), F.right("t", F.lit(2)).alias("end")).first()
    assert tuple(row) == (3_000_001, "jA")
