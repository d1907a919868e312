"""N-gram Jaccard join with a prefix tree.

Documents become sets of hashed word n-grams. Equal sets are one class. Links between classes are found
in steps, each without loss:

1. Signatures. The hash range is cut into more segments than two similar sets of that size can differ in,
   so they agree on some segments as a whole; how many is known. Sets that have fewer segments in common
   with any others are done.
2. Trees. Sets that hang together by signatures form one prefix tree, which each of them walks
   (`trie.py`), if they fit one.
3. Prefixes. Larger groups are put in one global order, n-grams that stand in many sets last. Two similar
   sets have a common n-gram among the first few of each. A document goes to the blocks of these
   n-grams, and a block is a tree. One too large for a tree is cut into chunks, each with the block's
   first set. Sets that are linked to it need no further look, as they are in one component; only those
   that are not meet the other chunks.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelog.llm.batches import mixed, slices, texts
from stridelog.llm.components import components
from stridelog.llm.text import same_row, sized, text_of
from stridelog.llm.trie import linked_groups
from stridelog.session import written

#: N-grams and sets in one tree. They only set the size of a task.
CHUNK_GRAMS, CHUNK_SETS = 400_000, 512
#: N-grams that are known to be common; they only set the order.
COMMON_GRAMS = 500_000
U = np.uint64


class Words(dict):
    """Hashes of words, kept for those seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def grams(text: bytes | None, n: int, known: Words) -> np.ndarray:
    """The sorted set of n-gram hashes of a text: A-Z lower-cased, words between ASCII white space.

    Fewer than `n` words are one n-gram, no words none.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, U)
    hashes = np.fromiter(map(known.__getitem__, words), U, len(words))
    if len(words) < n:
        return mixed(np.array([xxhash.xxh64_intdigest(hashes.tobytes(), len(words))], U))
    total = np.zeros(len(words) - n + 1, U)
    for k in range(n):
        total = mixed(total + hashes[k : k + len(total)])
    return np.unique(total)


@lru_cache
def levels(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """First size of each level, and its number of segments.

    A pair belongs to the level of its smaller set; the levels are wider than two linked sizes can
    differ, so a set takes part in its own level and at most in the one before.
    """
    first, segments = [1], []
    while first[-1] < 1 << 40:
        # At least 100 / percent times as wide.
        first.append(max(first[-1] + 1, -(-first[-1] * max(3 * percent, 200) // (2 * percent))))
        small = first[-1] - 1
        differ = apart(small + small * 100 // percent, percent)
        # Some more than needed, so that enough of them are not empty.
        segments.append(differ + 3 + differ // 8 if differ else 0)
    return np.array(first), np.array(segments)


def apart(both: int, percent: int) -> int:
    """The most n-grams that two linked sets with `both` n-grams together can differ in."""
    return both * (100 - percent) // (100 + percent)


def signatures(hashes: np.ndarray, percent: int) -> tuple[np.ndarray, list[int]]:
    """One number for each segment's content, for the set's own level and the one before.

    The lowest bit tells the levels apart. Also returned, by that bit, how many of its numbers a set
    must at least have in common with a set it is linked to; 0 where it takes no part.
    """
    first, segments = levels(percent)
    n = len(hashes)
    own = int(np.searchsorted(first, n, "right")) - 1
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mixed(hashes ^ U(0x5851F42D4C957F2D)))])
    out, least = [], [0, 0]
    for level in (own, own - 1):
        if level < 0 or not segments[level]:
            continue
        below = int(first[own]) - 1
        if level < own and n * percent > below * 100:
            continue  # too large for any set of the level before
        differ = apart(n + (n * 100 // percent if level == own else below), percent)
        if not differ:
            continue
        m = int(segments[level])
        edges = np.searchsorted(((hashes >> U(32)) * U(m)) >> U(32), np.arange(m + 1, dtype=U))
        marks = mixed(sums[edges[1:]] - sums[edges[:-1]] + mixed(np.arange(m, dtype=U) + U(level << 40)))
        marks = (marks & ~U(1)) | U(level & 1)
        filled = edges[1:] > edges[:-1]
        # Every n-gram that differs spoils one segment. Empty segments tell nothing; they are needed
        # only if the others could all be spoiled.
        spare = int(filled.sum()) - differ
        out.append(marks[filled] if spare > 0 else marks)
        least[level & 1] = max(spare, 1)
    return np.concatenate(out) if out else np.zeros(0, U), least


def _array_of(lists: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    values = np.concatenate([np.zeros(0, U), *lists]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _profiles(documents: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key and the signatures; a set repeated within a task has them once."""

    def profiled(batches):
        known, seen = Words(), set()
        for batch in slices(batches):
            sizes, keys, marks, least = [], [], [], []
            for text in texts(batch):
                hashes = grams(text, n, known)
                key = xxhash.xxh64_intdigest(hashes.tobytes())
                sizes.append(len(hashes))
                keys.append(key)
                made = (np.zeros(0, U), [0, 0]) if key in seen else signatures(hashes, percent)
                marks.append(made[0])
                least.append(made[1])
                seen.add(key)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(np.array(keys, U).view(np.int64)),
                    _array_of(marks), pa.array(least, pa.list_(pa.int32())),
                ],
                ["doc_id", "text_key", "n_shingles", "set_key", "marks", "least"],
            )

    schema = "doc_id long, text_key long, n_shingles long, set_key long, marks array<long>, least array<int>"
    return _narrow(documents).mapInArrow(profiled, schema)


def _narrow(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("text_key"), F.col("text").cast("string").alias("text"))


def _shared(postings: DataFrame, what: str, label: str) -> DataFrame:
    """(pivot, node) for each `what` that several nodes have: pivot is the least of them."""
    # Both sides below read this one exchange.
    dealt = postings.repartition(F.col(what))
    several = dealt.groupBy(what).agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot < last").select(what, "pivot")
    return written(dealt.join(several, what).select("pivot", "node").distinct(), label)


def jaccard_classes(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, set_key, component_id of each row: linked if 100 * common >= percent * union.

    component_id is the least doc_id that links lead to, the row's own included. Sets are compared by 64-bit
    hashes. Rows without words have no set and are linked with nothing; rows with a null doc_id are
    not linked and have no component. Rows with one doc_id are one node. Other columns are not read.
    """
    profiles, classes, links = _joined(documents, n, percent)
    parts = components(links.unionByName(_same_id(profiles)))
    named = classes.join(parts, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    named = written(named, "gram-parts")
    least = named.groupBy("component").agg(F.min("first.doc_id").alias("component_id"))
    found = named.join(least, "component").select(F.col("node").alias("k"), "component_id")
    return profiles.join(found, (F.col("set_key") == F.col("k")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), "left").select(
        "doc_id", "n_shingles", "set_key", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def _joined(documents: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The profiles, the classes (node, first) and links (a, b) between them.

    A node is the key of a set, so texts that share a doc_id are different nodes; `first` is the least row
    (doc_id, text_key) that has the set.
    """
    profiles = written(_profiles(documents, n, percent), "gram-profiles")
    classes = (
        profiles.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
        .groupBy(F.col("set_key").alias("node")).agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    )
    classes = written(classes, "gram-classes")
    marks = profiles.where(F.size("marks") > 0).select("set_key", F.explode("marks").alias("mark"))
    # Both sides of the join read this one exchange.
    dealt = marks.repartition("mark")
    several = dealt.groupBy("mark").agg(F.min("set_key").alias("a"), F.max("set_key").alias("b")).where("a < b").select("mark")
    shared = written(dealt.join(several, "mark").distinct(), "gram-marks")
    least = profiles.where(F.size("marks") > 0).select("set_key", "least", "n_shingles").dropDuplicates(["set_key"])
    side = F.col("mark").bitwiseAND(1).cast("int")
    able = (
        shared.groupBy("set_key", side.alias("side"))
        .agg(F.count(F.lit(1)).alias("have"))
        .join(least, "set_key")
        .where(F.col("have") >= F.get("least", F.col("side")))
        .select("set_key", F.col("n_shingles").alias("size"))
        .distinct()
    )
    searched = written(classes.join(able.withColumnRenamed("set_key", "node"), "node"), "gram-open")
    return profiles, classes, _links(documents, searched, shared, n, percent)


def _same_id(profiles: DataFrame) -> DataFrame:
    """Links between the classes of rows that share a doc_id."""
    rows = profiles.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).select("doc_id", F.col("set_key").alias("node")).distinct()
    least = rows.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("high")).where("b < high").select("doc_id", "b")
    return rows.join(least, "doc_id").select(F.col("node").alias("a"), "b")


def _texts_of(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of `wanted` (node, first, ...) with the text of row `first`, as often as that row is repeated."""
    wanted = wanted.select("*", F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key")).drop("first")
    return sized(wanted).join(_narrow(documents), ["doc_id", "text_key"])


def _links(documents: DataFrame, searched: DataFrame, shared: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) between nodes that join all nodes of a component."""
    marks = shared.withColumnRenamed("set_key", "node").join(searched, "node").select("mark", "node")
    # What hangs together by signatures is one unit if it fits a tree, so each of its texts is sent once.
    whole = components(_shared(marks, "mark", "gram-pairs").select(F.col("node").alias("a"), F.col("pivot").alias("b")))
    whole = written(whole.join(searched, "node"), "gram-groups")
    totals = whole.groupBy("component").agg(((F.sum("size") <= CHUNK_GRAMS) & (F.count(F.lit(1)) <= CHUNK_SETS)).alias("fits"))
    whole = whole.join(totals, "component")
    fitting = whole.where("fits").select(F.col("component").alias("pivot"), "node", "size", F.lit(1).alias("chunks"), F.lit(0).alias("chunk"))
    members = written(fitting.unionByName(_blocks(documents, whole.where(~F.col("fits")), n, percent)), "gram-members")
    # The pivot is in every chunk of its block.
    pivots = members.where("chunks > 1 AND node = pivot").select("pivot", "node", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    first = members.select("pivot", "chunk", "node").unionByName(pivots.select("pivot", "chunk", "node")).distinct()
    joined = written(_trees(documents, searched, first.withColumn("piece", F.lit(0)), n, percent), "gram-links")

    # Sets of cut blocks that are not linked to the pivot meet all chunks.
    apart_ = (
        joined.select("pivot", "node", "with_pivot").groupBy("pivot", "node").agg(F.max("with_pivot").alias("with_pivot"))
        .where(~F.col("with_pivot"))
        .join(members.where("chunks > 1"), ["pivot", "node"])
    )
    pieces = apart_.groupBy("pivot").agg(
        F.greatest(F.ceil(F.sum("size") / CHUNK_GRAMS), F.ceil(F.count(F.lit(1)) / CHUNK_SETS)).cast("int").alias("pieces")
    )
    apart_ = apart_.join(pieces, "pivot").select(
        "pivot", "node", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("pieces")).cast("int").alias("piece")
    )
    others = members.join(pieces, "pivot").select("pivot", "node", "chunk", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    second = apart_.unionByName(others.select("pivot", "node", "chunk", "piece")).distinct()
    rest = _trees(documents, searched, second, n, percent)
    return joined.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(rest.select(F.col("node").alias("a"), F.col("root").alias("b"))).where("a != b")


def _blocks(documents: DataFrame, searched: DataFrame, n: int, percent: int) -> DataFrame:
    """Members of prefix blocks (pivot, node, size, chunks, chunk), a large block in chunks by the hash of the node."""
    wanted = written(searched.select("node", "first", "size"), "gram-large")
    if wanted.isEmpty():
        return wanted.select(F.col("node").alias("pivot"), "node", "size", F.lit(1).alias("chunks"), F.lit(0).alias("chunk"))
    common = documents.sparkSession.sparkContext.broadcast(_common(_texts_of(documents, wanted), n))

    def beginnings(batches):
        known, (names, counts) = Words(), common.value
        for batch in slices(batches):
            firsts = []
            for text in texts(batch):
                hashes = grams(text, n, known)
                size = len(hashes)
                often = np.zeros(size, np.int64)
                if len(names):
                    at = np.minimum(np.searchsorted(names, hashes), len(names) - 1)
                    often = np.where(names[at] == hashes, counts[at], 0)
                # The least overlap with any linked set is percent of this one.
                length = size - -(-percent * size // 100) + 1
                firsts.append(hashes[np.lexsort((hashes, often))[:length]])
            yield pa.RecordBatch.from_arrays([batch.column("node"), _array_of(firsts)], ["node", "firsts"])

    starts = _texts_of(documents, wanted).mapInArrow(beginnings, "node long, firsts array<long>")
    blocks = _shared(starts.select("node", F.explode("firsts").alias("gram")), "gram", "gram-blocks")
    members = blocks.join(wanted.groupBy("node").agg(F.max("size").alias("size")), "node")
    chunks = members.groupBy("pivot").agg(
        F.greatest(F.ceil(F.sum("size") / CHUNK_GRAMS), F.ceil(F.count(F.lit(1)) / CHUNK_SETS)).cast("int").alias("chunks")
    )
    return members.join(chunks, "pivot").select(
        "pivot", "node", "size", "chunks", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk")
    )


def _common(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that stand in most sets, sorted, and how often they were met, as far as a task meets them repeatedly."""

    def counted(batches):
        known, kept, size = Words(), [], 0

        def out():
            values, times = np.unique(np.concatenate([np.zeros(0, U), *kept]), return_counts=True)
            often = times >= 3
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(times[often].astype(np.int64))], ["gram", "times"])

        for batch in slices(batches):
            for text in texts(batch):
                kept.append(grams(text, n, known))
                size += len(kept[-1])
            if size > 4_000_000:
                yield out()
                size = 0
        yield out()

    sums = rows.mapInArrow(counted, "gram long, times long").groupBy("gram").agg(F.sum("times").alias("times"))
    sums = written(sums.where("times >= 8"), "gram-common")
    total = sums.agg(F.sum("times").alias("n")).first()["n"] or 0
    # Those with a share of at least 1 / COMMON_GRAMS are at most so many. Which n-grams the list has
    # changes the work, not the result.
    top = sums.where(F.col("times") * COMMON_GRAMS >= total).toPandas()
    names, counts = top["gram"].to_numpy(np.int64).view(U), top["times"].to_numpy(np.int64)
    order = np.argsort(names)
    return names[order], counts[order]


def _trees(documents: DataFrame, searched: DataFrame, units: DataFrame, n: int, percent: int) -> DataFrame:
    """pivot, node, root, with_pivot: nodes of each unit (pivot, chunk, piece) with the least node of their group."""
    unit = ["pivot", "chunk", "piece"]
    rows = _texts_of(documents, searched.select("node", "first").join(units, "node"))
    rows = rows.repartition(*unit).sortWithinPartitions(*unit, "node").select(*unit, "node", "text")

    def walked(batches):
        known = Words()
        at, nodes, sets = None, [], []

        def out():
            group = linked_groups(sets, percent)
            least: dict[int, int] = {}
            for g, node in zip(group.tolist(), nodes, strict=True):
                least[g] = min(least.get(g, node), node)
            near = {g for g, node in zip(group.tolist(), nodes, strict=True) if node == at[0]}
            roots = [least[g] for g in group.tolist()]
            return pa.RecordBatch.from_arrays(
                [pa.array([at[0]] * len(nodes), pa.int64()), pa.array(nodes, pa.int64()), pa.array(roots, pa.int64()), pa.array([g in near for g in group.tolist()])],
                ["pivot", "node", "root", "with_pivot"],
            )

        for batch in slices(batches):
            columns = [batch.column(c).to_pylist() for c in (*unit, "node")]
            for *place, node, text in zip(*columns, texts(batch), strict=True):
                if place != at:
                    if nodes:
                        yield out()
                    at, nodes, sets = place, [], []
                elif nodes[-1] == node:
                    continue  # the row is repeated
                nodes.append(node)
                sets.append(grams(text, n, known))
        if nodes:
            yield out()

    return rows.mapInArrow(walked, "pivot long, node long, root long, with_pivot boolean")


def one_of_each(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Of the rows that links join, the least by (doc_id, set, text); rows are told by doc_id and text.

    Only sets link here: other texts under the same doc_id stay. Of rows repeated as a whole the
    least by all columns that have an order stays. Rows without words or without a doc_id stay.
    """
    profiles, classes, links = _joined(documents, n, percent)
    parts = classes.join(components(links), "node", "left").select(F.col("node").alias("set_key"), F.coalesce("component", "node").alias("component"))
    found = profiles.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).join(parts, "set_key").select("component", F.struct("doc_id", "set_key", "text_key").alias("row"))
    found = written(found.groupBy("component", "row").agg(F.count(F.lit(1)).alias("times")), "gram-components")
    first = written(found.groupBy("component").agg(F.min("row").alias("first")), "gram-first")
    named = [F.col("row.doc_id").alias("llm_id"), F.col("row.text_key").alias("llm_key")]
    judged = found.join(first, "component")
    going = written(judged.where("row != first").select(*named), "gram-going")
    kept = documents.join(sized(going), same_row(documents, going), "left_anti")
    twice = written(judged.where("row = first AND times > 1").select(*named), "gram-twice")
    if twice.isEmpty():
        return kept
    names = [f"`{c}`" for c in documents.columns]
    sortable = [f"`{f.name}`" for f in documents.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    again = kept.join(sized(twice), same_row(documents, twice), "left_semi")
    whole, order = F.struct(*names), F.struct(*sortable)
    single = again.groupBy(F.col("doc_id").alias("llm_id"), F.xxhash64(text_of()).alias("llm_key")).agg(F.min_by(whole, order).alias("llm_row")).select("llm_row.*")
    return kept.join(sized(twice), same_row(documents, twice), "left_anti").unionByName(single)
