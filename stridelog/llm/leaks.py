"""Benchmark decontamination by fingerprints of item-sized windows.

1. Word shingles of all documents are joined to those of the benchmark. A document can only reach the
   similarity asked for with an item if it shares that part of the item's weight. So it shares one of the
   item's heaviest (rarest) shingles, those before the rest weighs too little: only they name (document,
   item) pairs, and shingles that many items have, such as a common stem, name none. The shared weight of
   each pair is then added up over all shingles of the item. Neither step loses a pair.
2. For the pairs left, every shared shingle places a window of the item's size in the document. Windows and
   items get 64-bit SimHash fingerprints over their words.
3. Fingerprints meet by blocks: of 5 blocks, two fingerprints within 19 bits differ by at most 3 bits in
   one. Items are listed under every block value up to 3 bits away, so an equi-join finds all pairs
   within the radius, of any item of that size.
4. Pairs within the radius are verified by the exact similarity of their weighted shingle sets.

Steps 1, 3 and 4 are exact for their conditions; what is lost are windows that are similar enough but lie
beyond the radius. A test measures how many edited passages are found that way.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from stridelog.llm.text import same_row, sized, text_of, trigrams
from stridelog.session import written

SHINGLE = 3
#: First bit and number of bits of each block.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Bits by which one block may differ; RADIUS // len(BLOCKS) for the guarantee.
BLOCK_RADIUS = 3
RADIUS = len(BLOCKS) * (BLOCK_RADIUS + 1) - 1


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def fingerprint(words: Column) -> Column:
    """64-bit SimHash: each bit is the majority over the words' hashes."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def bit(b: Column) -> Column:
        ones = F.aggregate(hashes, F.lit(0), lambda n, h: n + F.call_function("getbit", h, b).cast("int"))
        return F.when(ones * 2 > F.size(words), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), bit)
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def _blocks(mark: Column) -> Column:
    return F.array(
        *(
            F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(mark, at).bitwiseAND((1 << size) - 1).cast("int").alias("value"))
            for i, (at, size) in enumerate(BLOCKS)
        )
    )


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, n, mark, weighted (gram, weight), total, mean; equal rows once, items below a shingle not at all."""
    items = (
        benchmark.select("item_id", _words(text_of()).alias("words"))
        .where(F.size("words") >= SHINGLE)
        .distinct()
        .withColumn("grams", F.array_distinct(trigrams(F.col("words"))))
        .withColumn("item_key", F.xxhash64("item_id", "words"))
    )
    grams = items.select("item_key", F.explode("grams").alias("gram"))
    spread = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("items"))
    n_items = items.agg(F.count(F.lit(1)).alias("n_items"))
    weight = 1 + F.ln(n_items.scalar() / F.col("items"))
    weighted = (
        grams.join(spread, "gram")
        .withColumn("weight", weight)
        .groupBy("item_key")
        .agg(F.sort_array(F.collect_list(F.struct("gram", "weight"))).alias("weighted"), F.sum("weight").alias("total"))
    )
    return items.join(weighted, "item_key").select(
        "item_key", "item_id", "words", F.size("words").alias("n"), fingerprint(F.col("words")).alias("mark"), "weighted", "total",
        (F.col("total") / F.size("weighted")).alias("mean"),
    )


def _heaviest_first() -> WindowSpec:
    return Window.partitionBy("item_key").orderBy(F.desc("weight"), "gram").rowsBetween(Window.unboundedPreceding, 0)


def _may_lead(least: float) -> Column:
    """Whether this shingle and all lighter ones together reach the weight asked for; a bit is left for rounding."""
    return F.col("total") - F.col("before") >= F.lit(least * (1 - 1e-9)) * F.col("total")


def _same_gram() -> Column:
    return F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("text_key")) & (F.col("g") == F.col("gram"))


def leaked_windows(documents: DataFrame, benchmark: DataFrame, least: float = 0.5) -> DataFrame:
    """Windows of documents that hold a benchmark item: doc_id, text_key, item_id, start, n, distance, similarity.

    The best window (most similar, then first) for each document row and item. `similarity` is shared
    weight over all weight of the shingle sets of window and item; a shingle weighs 1 + ln(items /
    items that have it), and one foreign to the item weighs as the item's mean. Words are runs of
    letters and digits, lower-cased. Items below three words are not looked for. Null and empty texts hold
    nothing; rows equal in doc_id and text give one row; other columns are not read.
    """
    items = written(_items(benchmark), "leak-items")
    placed = items.select("item_key", "n", "total", F.posexplode(trigrams(F.col("words"))).alias("place", "gram"))
    weights = items.select("item_key", F.col("n"), F.col("total"), F.inline("weighted"))

    rows = documents.select("doc_id", text_of().alias("text")).withColumn("text_key", F.xxhash64("text"))
    grams = rows.select("doc_id", "text_key", F.posexplode(trigrams(_words(F.col("text")))).alias("at", "gram"))
    hits = written(grams.join(sized(placed.select("gram").distinct()), "gram"), "leak-hits")

    leading = weights.withColumn("before", F.sum("weight").over(_heaviest_first()) - F.col("weight")).where(_may_lead(least))
    named = hits.select("doc_id", "text_key", "gram").distinct().join(sized(written(leading.select("item_key", "gram"), "leak-leading")), "gram")
    named = written(named.select("doc_id", "text_key", "item_key").distinct(), "leak-named")
    # All shingles of the items that a document is named with, told by document and shingle from here on.
    wanted = named.join(weights, "item_key").select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "item_key", F.col("gram").alias("g"), "weight", "total")
    able = (
        wanted.join(hits.select("doc_id", "text_key", "gram").distinct(), _same_gram(), "left_semi")
        .groupBy("d", "k", "item_key")
        .agg(F.sum("weight").alias("shared"), F.max("total").alias("total"))
        .where(F.col("shared") >= least * F.col("total"))
        .select("d", "k", "item_key")
    )
    spots = able.join(placed, "item_key").select("d", "k", "n", "place", F.col("gram").alias("g"))
    starts = (
        spots.join(hits, _same_gram())
        .select(F.col("doc_id").alias("llm_id"), F.col("text_key").alias("llm_key"), F.greatest(F.col("at") - F.col("place"), F.lit(0)).alias("start"), "n")
        .distinct()
    )
    starts = written(starts, "leak-starts")
    # The texts again, only of documents with a window.
    windows = (
        documents.select("doc_id", "text")
        .transform(lambda d: d.join(sized(starts), same_row(d, starts)))
        .select(F.col("llm_id").alias("id"), F.col("llm_key").alias("key"), "start", "n", F.slice(_words(text_of()), F.col("start") + 1, F.col("n")).alias("words"))
        .distinct()
        .withColumn("mark", fingerprint(F.col("words")))
        .withColumn("grams", F.array_distinct(trigrams(F.col("words"))))
    )
    near = F.array(*(F.lit(sum(1 << b for b in bits)) for r in range(BLOCK_RADIUS + 1) for bits in combinations(range(13), r)))
    listed = items.select("item_key", "n", "mark", F.inline(_blocks(F.col("mark")))).select(
        F.col("n").alias("m"), F.col("mark").alias("item_mark"), "block", F.explode(F.transform(near, lambda mask: F.col("value").bitwiseXOR(mask))).alias("value"), "item_key"
    )
    met = (
        windows.select("id", "key", "start", "n", "mark", "grams", F.inline(_blocks(F.col("mark"))))
        .join(listed, ["block", "value"])
        # Fingerprints beyond the radius go in the join itself, before rows get wide.
        .withColumn("distance", F.bit_count(F.col("mark").bitwiseXOR(F.col("item_mark"))))
        .where((F.col("n") == F.col("m")) & (F.col("distance") <= RADIUS))
        .drop("block", "value", "m", "item_mark")
        .join(items.select("item_key", "item_id", "weighted", "total", "mean"), "item_key")
    )
    common = F.filter("weighted", lambda w: F.array_contains("grams", w.gram))
    shared = F.aggregate(common, F.lit(0.0), lambda s, w: s + w.weight)
    foreign = (F.size("grams") - F.size(common)) * F.col("mean")
    return (
        met.withColumn("similarity", shared / (F.col("total") + foreign))
        .where(F.col("similarity") >= least)
        .groupBy("id", "key", "item_id")
        .agg(F.max_by(F.struct("start", "n", "distance", "similarity"), F.struct("similarity", -F.col("start"))).alias("best"))
        .select(F.col("id").alias("doc_id"), F.col("key").alias("text_key"), "item_id", "best.*")
    )


def without_leaks(documents: DataFrame, benchmark: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows that hold no benchmark item, as they are."""
    leaks = leaked_windows(documents, benchmark, least).select(F.col("doc_id").alias("llm_id"), F.col("text_key").alias("llm_key")).distinct()
    leaks = written(leaks, "leaks")
    return documents.join(sized(leaks), same_row(documents, leaks), "left_anti")


def leak_report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return leaked_windows(documents, benchmark).drop("text_key")
