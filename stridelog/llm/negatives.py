"""Hard negatives by a secondary sort.

All pairs of an anchor and a row are scored in blocks: groups of rows are held, the anchors stream by. Of each
group and anchor only what can be among the first is passed on, so what is shuffled grows with
anchors times groups, not with pairs. Two passes do this, the first for positives, the second for negatives
inside the positives' windows. Then (anchor, descending score, positives first, id) is packed into one
key, `repartitionAndSortWithinPartitions` deals keys by anchor and sorts them, and an iterator goes along
each anchor once: a positive opens its window, a negative goes to every window that it falls into.
It holds the open windows only.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridelog.session import written

#: Rows that a task holds at a time, and anchors that it scores at once.
HELD, AT_ONCE = 4096, 512
KEY = struct.Struct(">QQBQ")
TOP = (1 << 63) - 1


def packed(anchor: int, score: int, negative: bool, row: int) -> bytes:
    """A key that sorts as bytes by anchor, descending score, positives first, id."""
    return KEY.pack(anchor + TOP + 1, TOP - score, negative, row + TOP + 1)


def unpacked(key: bytes) -> tuple[int, int, bool, int]:
    anchor, score, negative, row = KEY.unpack(key)
    return anchor - TOP - 1, TOP - score, bool(negative), row - TOP - 1


def mined(keys: Iterator[bytes], negatives: int, low: int, high: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(anchor, positive, rank, negative, positive's score, negative's score) from sorted keys."""
    now, windows = None, []
    for key in keys:
        anchor, score, negative, row = unpacked(key)
        if anchor != now:
            now, windows = anchor, []
        if not negative:
            windows.append([row, score, 0])
            continue
        # Scores only fall from here, so a window above this one is over.
        windows = [w for w in windows if low * w[1] <= 100 * score and w[2] < negatives]
        for window in windows:
            if 100 * score <= high * window[1]:
                window[2] += 1
                yield anchor, window[0], window[2], row, window[1], score


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `rows` has vec_id, label and embedding; `anchors` is a condition over vec_id. A component x counts as
    floor(scale * x), a score is the integer inner product, cut to the range of a long. Rows with a null id,
    label, vector or component or a component that is not finite take no part; nor do vectors of different
    lengths meet. An anchor's positives are its first rows of the same label and another id, the
    negatives its first rows of other labels with low * positive <= 100 * negative <= high * positive; higher scores
    come first, then smaller ids. Of rows repeated under an anchor's id the least (label, vector) is the
    anchor; other repeated rows count as often as they stand there. Other columns are not read.
    """
    if not 0 <= low <= high <= 100:
        raise ValueError("0 <= low <= high <= 100 is needed: negatives must not come before their positive")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    asked = rows.where(anchors & finite).groupBy(F.col("vec_id").alias("anchor")).agg(F.min(F.struct("label", "embedding")).alias("a"))
    asked = written(asked.select("anchor", "a.label", "a.embedding"), "negatives-anchors")
    groups = max(1, -(-rows.count() // HELD))
    # Dealt by place and not by id, so that repeated ids spread like all others.
    dealt = rows.withColumn("unit", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    found = _scored(dealt, asked.withColumn("wanted", F.array().cast("array<long>")), groups, scale, lambda *x: _first(*x, positives))
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "row"))
    best = written(found.withColumn("place", place).where(F.col("place") <= positives).drop("place"), "negatives-positives")
    wanted = asked.join(best.groupBy("anchor").agg(F.collect_list("score").alias("wanted")), "anchor")
    near = _scored(dealt, wanted, groups, scale, lambda *x: _inside(*x, negatives, low, high))

    keys = best.select("anchor", "score", F.lit(False).alias("negative"), "row")
    keys = keys.unionByName(near.select("anchor", "score", F.lit(True).alias("negative"), "row")).rdd.map(lambda r: (packed(*r), None))
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:8]) % parts)
    out = ordered.mapPartitions(lambda part: mined((key for key, _ in part), negatives, low, high))
    return spark.createDataFrame(out, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def _scored(dealt: DataFrame, asked: DataFrame, groups: int, scale: int, choose) -> DataFrame:
    """(anchor, row, score): what `choose` takes of each group for each anchor."""
    held = dealt.select("unit", F.lit(0).alias("role"), F.col("vec_id").alias("id"), "label", "embedding", F.array().cast("array<long>").alias("wanted"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    passing = asked.select(F.col("anchor").alias("id"), "label", "embedding", "wanted", F.lit(1).alias("role")).select("*", every.alias("unit"))
    rows = held.unionByName(passing).repartition(groups, "unit").sortWithinPartitions("unit", "role")

    def scored(batches):
        unit, block, blocks = None, Block(scale), []
        for batch in batches:
            places = batch.column("unit").to_numpy(zero_copy_only=False)
            roles = batch.column("role").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(places) != 0) | (np.diff(roles) != 0)) + 1
            for start, end in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if start == end:
                    continue
                if places[start] != unit:
                    unit, block, blocks = places[start], Block(scale), []
                part = batch.slice(start, end - start)
                if not roles[start]:
                    block.add(part)
                    continue
                blocks = blocks or block.parts()
                for at in range(0, part.num_rows, AT_ONCE):
                    streaming = Block(scale)
                    streaming.add(part.slice(at, AT_ONCE))
                    for some in streaming.parts():
                        for whole in blocks:
                            if some.matrix.shape[1] == whole.matrix.shape[1]:
                                yield _batch(*choose(some, whole, products(some.matrix, whole.matrix)))

    return rows.mapInArrow(scored, "anchor long, row long, score long")


def _batch(anchors: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (anchors, rows, scores)], ["anchor", "row", "score"])


class Block:
    """Rows with the same length of vector, in order of their ids."""

    def __init__(self, scale: int) -> None:
        self.scale, self.rows = scale, {}

    def add(self, batch: pa.RecordBatch) -> None:
        lists = batch.column("embedding")
        offsets = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
        sizes = np.diff(offsets)
        flat = values[offsets[0] : offsets[-1]]
        wanted = batch.column("wanted").to_pylist()
        ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
        for size in np.unique(sizes).tolist():
            chosen = np.flatnonzero(sizes == size)
            matrix = flat[(offsets[chosen] - offsets[0])[:, None] + np.arange(size)]
            # A null component is not a number here.
            whole = np.isfinite(matrix).all(axis=1)
            chosen, matrix = chosen[whole], matrix[whole]
            self.rows.setdefault(size, []).append((ids[chosen], labels[chosen], np.floor(matrix * self.scale), [wanted[i] for i in chosen]))

    def parts(self) -> list[Part]:
        return [Part(*(np.concatenate([x[i] for x in some]) for i in range(3)), [w for x in some for w in x[3]]) for some in self.rows.values()]


class Part:
    def __init__(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray, wanted: list[list[int]]) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.matrix = ids[order], labels[order], matrix[order]
        self.wanted = [wanted[i] for i in order]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of `a` with all of `b`: floats where they are exact, else Python's integers."""
    out = a @ b.T
    most = (2.0**53 / max(a.shape[1], 1)) ** 0.5
    wide_a, wide_b = (np.abs(x).max(axis=1, initial=0) >= most for x in (a, b))
    if not wide_a.any() and not wide_b.any():
        return out.astype(np.int64)
    # Infinite or inexact where a row is wide; those are made again below.
    out = np.where(np.isfinite(out), out, 0).clip(-(2.0**62), 2.0**62).astype(np.int64)
    for i in range(len(a)):
        for j in np.flatnonzero(wide_b | wide_a[i]).tolist():
            exact = sum(int(x) * int(y) for x, y in zip(a[i].tolist(), b[j].tolist(), strict=True))
            out[i, j] = max(-TOP, min(TOP, exact))
    return out


def _leading(scores: np.ndarray, able: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the first `count` able scores of each row: higher first, then smaller columns."""
    rows, columns = scores.shape
    if not rows or not columns:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if columns > count:
        # Whatever is not below the last of the first `count` values may be among them.
        floor = np.partition(np.where(able, scores, -TOP), columns - count, axis=1)[:, columns - count]
        able = able & (scores >= floor[:, None])
    row, column = np.nonzero(able)
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    starts = np.searchsorted(row, np.arange(rows))
    first = np.arange(len(row)) - starts[row] < count
    return row[first], column[first]


def _first(some: Part, whole: Part, scores: np.ndarray, count: int):
    able = (some.labels[:, None] == whole.labels[None, :]) & (some.ids[:, None] != whole.ids[None, :])
    row, column = _leading(scores, able, count)
    return some.ids[row], whole.ids[column], scores[row, column]


def _inside(some: Part, whole: Part, scores: np.ndarray, count: int, low: int, high: int):
    other = some.labels[:, None] != whole.labels[None, :]
    places = []
    for k in range(max(map(len, some.wanted), default=0)):
        # 100 * score between low * p and high * p, as whole numbers; above any score where there is no such positive
        bottom = np.array([-(-low * w[k] // 100) if k < len(w) else TOP for w in some.wanted])
        top = np.array([high * w[k] // 100 if k < len(w) else -TOP for w in some.wanted])
        row, column = _leading(scores, other & (scores >= bottom[:, None]) & (scores <= top[:, None]), count)
        places.append(row * len(whole.ids) + column)
    # Repeated places are one, repeated rows are not.
    place = np.unique(np.concatenate([np.zeros(0, np.int64), *places]))
    row, column = np.divmod(place, max(len(whole.ids), 1))
    return some.ids[row], whole.ids[column], scores[row, column]
