"""Near duplicates by one-permutation MinHash.

One hash permutation is cut into bins; a set's signature is the least value in each bin, and an empty bin
borrows from a full one that a fixed probe sequence of its own leads to, the same for all sets (optimal
densification). Rows of the signature make bands; sets that agree on a whole band share its bucket.

1. Stars. Each bucket has a centre, the least member by a hash that differs from bucket to bucket. Only
   (centre, member) is a candidate, so candidates are at most one per set and band, however large a
   group of copies is. They are confirmed on full sets.
2. Rest. A star can miss a link between two members that are both unlike the centre. In buckets whose
   members do not hang together yet, every member outside the largest part is compared with all members
   of other parts: pieces of at most `PIECE` such sets are held, the others stream by.

So all links between sets that share a bucket are found. Sets with a similarity at the threshold share
none in less than 1 of 10,000 cases, whatever their size.
"""

from __future__ import annotations

from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelog.llm.batches import mixed, slices, texts
from stridelog.llm.components import components
from stridelog.llm.jaccard import Words, grams
from stridelog.llm.text import same_row, sized, text_of
from stridelog.session import written

U = np.uint64
#: A power of two: the number of a band is kept in the lowest bits of its mark.
BANDS = 32
#: Sets that one task holds at a time, and members that stream by it.
PIECE, STREAM = 512, 4096


@lru_cache
def rows_per_band(percent: int) -> int:
    """So many that two sets at the threshold agree on a band in about a third of all bands."""
    return min(8, max(1, round(log(0.36) / log(min(percent, 99) / 100))))


@lru_cache
def _bins(count: int) -> tuple[np.ndarray, np.ndarray]:
    """The least hash of each bin, and where an empty bin looks: row t has the bin that attempt t leads to."""
    first = np.array([i * (1 << 64) // count for i in range(count)], U)
    steps = np.arange(64 * count, dtype=U).reshape(64, count)
    return first, (mixed(steps + U(0x2545F4914F6CDD1D)) % U(count)).astype(np.int64)


def signature(hashes: np.ndarray, count: int) -> np.ndarray:
    """The densified one-permutation signature of a non-empty set of hashes."""
    first, probes = _bins(count)
    values = np.sort(mixed(hashes ^ U(0x9FB21C651E98DF25)))
    at = np.searchsorted(values, first)
    full = np.append(at[1:], len(values)) > at
    out = values[np.minimum(at, len(values) - 1)]
    empty, attempt = np.flatnonzero(~full), 0
    while len(empty):
        # After 64 attempts the sequences go on shifted, until each has met a full bin.
        lead = (probes[attempt % 64][empty] + attempt // 64) % count
        found = full[lead]
        out[empty[found]] = out[lead[found]]
        empty, attempt = empty[~found], attempt + 1
    return out


def bands(hashes: np.ndarray, percent: int) -> np.ndarray:
    """One mark for each band; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, U)
    rows = rows_per_band(percent)
    parts = signature(hashes, BANDS * rows).reshape(rows, BANDS)
    marks = np.zeros(BANDS, U)
    for part in parts:
        marks = mixed(marks + part)
    number = np.arange(BANDS, dtype=U)
    return (mixed(marks + number) & ~U(BANDS - 1)) | number


def minhash_classes(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key, component_id, kept of each row.

    Rows are linked if 100 * common >= percent * union of their sets of word n-grams; component_id is the least
    doc_id that links lead to, the row's own included, and kept says that it is the row's own. Sets are
    compared by 64-bit hashes of n-grams. Null and empty texts have no set and are linked with nothing; rows
    with a null doc_id are not linked, have no component and are kept. Rows with one doc_id are one node,
    so repeated rows stay or go together. Other columns are not read. An empty table gives an empty result.
    """
    profiles = written(_profiles(documents, n, percent), "minhash-profiles")
    named = profiles.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = named.groupBy(F.col("set_key").alias("node")).agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.max("n_shingles").alias("size"))
    classes = written(classes, "minhash-classes")
    found = _links(documents, classes, written(_buckets(profiles), "minhash-buckets"), n, percent)
    same = named.select("doc_id", F.col("set_key").alias("node")).distinct()
    least = same.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("high")).where("b < high").select("doc_id", "b")
    parts = components(found.unionByName(same.join(least, "doc_id").select(F.col("node").alias("a"), "b")))
    whole = written(classes.join(parts, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component")), "minhash-parts")
    lowest = whole.groupBy("component").agg(F.min("first.doc_id").alias("component_id"))
    ids = whole.join(lowest, "component").select(F.col("node").alias("k"), "component_id")
    on = (F.col("set_key") == F.col("k")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    component = F.coalesce("component_id", "doc_id")
    return profiles.join(ids, on, "left").select(
        "doc_id", "text_key", "n_shingles", "set_key", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def without_near_copies(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `documents` that `minhash_classes` keeps, all their columns as they are."""
    going = minhash_classes(documents, n, percent).where("NOT kept").select(F.col("doc_id").alias("llm_id"), F.col("text_key").alias("llm_key")).distinct()
    going = written(going, "minhash-going")
    return documents.join(sized(going), same_row(documents, going), "left_anti")


def _narrow(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("text_key"), F.col("text").cast("string").alias("text"))


def _profiles(documents: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key and the marks; a set repeated within a task has them once."""

    def profiled(batches):
        known, seen = Words(), set()
        for batch in slices(batches):
            sizes, keys, marks = [], [], []
            for own, text in zip(batch.column("doc_id"), texts(batch), strict=True):
                hashes = grams(text, n, known)
                key = xxhash.xxh64_intdigest(hashes.tobytes())
                sizes.append(len(hashes))
                keys.append(key)
                new = own.is_valid and key not in seen
                marks.append(bands(hashes, percent) if new else np.zeros(0, U))
                if new:
                    seen.add(key)
            offsets = np.concatenate([[0], np.cumsum([len(m) for m in marks])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(np.array(keys, U).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(marks).view(np.int64))),
                ],
                ["doc_id", "text_key", "n_shingles", "set_key", "marks"],
            )

    return _narrow(documents).mapInArrow(profiled, "doc_id long, text_key long, n_shingles long, set_key long, marks array<long>")


def _buckets(profiles: DataFrame) -> DataFrame:
    """(mark, node, size, centre, most) of the members of each bucket of two or more sets."""
    marks = (
        profiles.where(F.size("marks") > 0)
        .select(F.explode("marks").alias("mark"), F.col("set_key").alias("node"), F.col("n_shingles").alias("size")).distinct()
    )
    marks = written(marks, "minhash-marks")
    several = marks.groupBy("mark").agg(F.min(F.struct(F.xxhash64("node", "mark").alias("at"), "node", "size")).alias("centre"), F.count(F.lit(1)).alias("most"))
    return marks.join(several.where("most > 1"), "mark")


def _links(documents: DataFrame, classes: DataFrame, buckets: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) between nodes that join all nodes of a component."""
    low, high = F.least("size", "centre.size"), F.greatest("size", "centre.size")
    edges = buckets.where((F.col("node") != F.col("centre.node")) & (100 * low >= percent * high)).select(F.col("centre.node").alias("centre"), "node").distinct()
    edges = written(edges, "minhash-edges")
    # Members of a centre stream in parts, each with the centre.
    parts = edges.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / STREAM).cast("int").alias("parts"))
    members = edges.join(parts, "centre").select(F.col("centre").alias("unit"), F.pmod(F.xxhash64("node"), "parts").cast("int").alias("piece"), F.lit(1).alias("role"), "node")
    centres = parts.select(F.col("centre").alias("unit"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("piece"), F.lit(0).alias("role"), F.col("centre").alias("node"))
    alone = members.unionByName(centres).withColumn("part", F.col("node"))
    stars = written(_confirmed(documents, classes, alone, n, percent), "minhash-stars")
    rest = written(_rest(buckets, components(stars)), "minhash-rest")
    if rest.isEmpty():
        return stars
    return stars.unionByName(_confirmed(documents, classes, rest, n, percent))


def _rest(buckets: DataFrame, parts: DataFrame) -> DataFrame:
    """(unit, piece, role, node, part): what the stars leave, role 0 to be held and role 1 to stream by it."""
    able = buckets.where("most > 2").select("mark", "node")
    able = able.join(parts, "node", "left").select("mark", "node", F.coalesce("component", "node").alias("part"))
    able = written(able, "minhash-able")
    # Buckets with the same members need one look.
    each = able.groupBy("mark", "part").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")
    )
    sums = each.groupBy("mark").agg(
        F.max(F.struct("n", "part")).alias("main"), F.count(F.lit(1)).alias("several"), F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")
    )
    once = sums.where("several > 1").groupBy("x", "y", "n").agg(F.min(F.struct("mark", "main")).alias("kept"))
    once = once.select("kept.mark", F.col("kept.main.part").alias("main"), F.ceil((F.col("n") - F.col("kept.main.n")) / PIECE).cast("int").alias("pieces"))
    members = able.join(once, "mark")
    piece = F.pmod(F.xxhash64("node"), "pieces").cast("int")
    held = members.where("part != main").select(F.col("mark").alias("unit"), piece.alias("piece"), F.lit(0).alias("role"), "node", "part")
    others = members.select(F.col("mark").alias("unit"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.lit(1).alias("role"), "node", "part")
    return held.unionByName(others)


class Held:
    """Sets to compare others with: their n-grams by number, one after the other."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets])
        self.names, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def linked(self, other: np.ndarray, percent: int) -> np.ndarray:
        """Places of the sets with 100 * common >= percent * union."""
        at = np.minimum(np.searchsorted(self.names, other), len(self.names) - 1)
        inside = np.zeros(len(self.names), np.int64)
        inside[at[self.names[at] == other]] = 1
        common = np.add.reduceat(inside[self.flat], self.starts)
        return np.flatnonzero(100 * common >= percent * (self.sizes + len(other) - common))


def _confirmed(documents: DataFrame, classes: DataFrame, units: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) in each (unit, piece) between streaming and held nodes of different parts, as many as join all that they link."""
    rows = sized(classes.select("node", "first")).join(units, "node")
    rows = rows.select("unit", "piece", "role", "node", "part", F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key"))
    rows = sized(written(rows, "minhash-units")).join(_narrow(documents), ["doc_id", "text_key"]).select("unit", "piece", "role", "node", "part", "text")
    rows = rows.repartition("unit", "piece").sortWithinPartitions("unit", "piece", "role", "node")

    def compared(batches):
        known = Words()
        at, held, sets, nodes, roots, last = None, None, [], [], {}, None

        def root(part):
            while roots.setdefault(part, part) != part:
                roots[part] = part = roots[roots[part]]
            return part

        for batch in slices(batches):
            pairs = []
            columns = [batch.column(c).to_pylist() for c in ("unit", "piece", "role", "node", "part")]
            for unit, piece, role, node, part, text in zip(*columns, texts(batch), strict=True):
                if (unit, piece) != at:
                    at, held, sets, nodes, roots, last = (unit, piece), None, [], [], {}, None
                if last == (role, node):
                    continue  # the row is repeated
                last = (role, node)
                if not role:
                    sets.append(grams(text, n, known))
                    nodes.append((node, part))
                    continue
                held = held or Held(sets)
                for place in held.linked(grams(text, n, known), percent).tolist():
                    other, its = nodes[place]
                    a, b = root(part), root(its)
                    if a != b:
                        roots[max(a, b)] = min(a, b)
                        pairs.append((node, other))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

    return rows.mapInArrow(compared, "a long, b long")
