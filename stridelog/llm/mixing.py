"""Mixing sources to target weights by weighted fair queueing.

Every source is a flow. Its documents stand in a shuffled but fixed order, a second round follows the
first, and a document's virtual finish time is the source's words up to and including it, divided by
the source's target. All documents are served by finish time until the total budget is used.

No task holds a whole source: the running sum of a source is built from sums of hash ranges. Up to
time 1 no source can be beyond its target, so all of that is taken without sorting; only what is left of
the budget is filled from the documents after time 1, in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridelog.llm.text import text_of, word_count
from stridelog.session import written

#: Hash ranges of a source, and ranges of finish times for each factor of e. They only set the size of a task.
RANGES, STEPS = 1 << 12, 1024


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, rounds: int = 2) -> DataFrame:
    """source, source_size, target, and on each row the budget, which is the sum of the targets.

    Sources by code point, null last, have the weights in turn. `share` of all words is dealt by
    weight; no target is above `rounds` times its source, and what is cut off goes to the others by
    weight. That is one level for all: the target is the smaller of `rounds` x size and level x
    weight, and the level is found by adding up the sources by size over weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), turn + 1)
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("ratio")
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    return (
        # One row for a source: small enough for one task.
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * float(rounds))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * share)
        .withColumn("level", level)
        # The first source that the level does not fill sets the level for all.
        .withColumn("level", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(everything)["level"])
        .select(
            "source", "source_size", F.least("most", F.coalesce(F.col("level") * F.col("weight"), "most")).alias("target"),
            F.least("total", F.sum("most").over(everything)).alias("budget"),
        )
    )


def mix(
    documents: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, rounds: int = 2, seed: int = 7
) -> DataFrame:
    """Each document row with size, source_size, target and `times`, how often the mix takes it.

    doc_id, text_key, source, size, source_size, target, times. A null text has size 0 and is taken
    no time, a null source is a source. Rows equal in all of doc_id, text and source share one place
    and are taken alike. Reruns agree, as order and ties depend on the rows alone.
    """
    rows = documents.select(
        "doc_id", F.xxhash64(text_of()).alias("text_key"), F.col("source").cast("string").alias("source"), word_count(text_of()).alias("size")
    )
    # Narrow rows, read three times below; the texts are read once.
    rows = written(rows, "mix-sizes")
    targets = source_targets(rows, weights, share, rounds)

    # Equal rows are one place in the order, with their sizes together.
    place = F.xxhash64(F.lit(seed), "doc_id", "text_key")
    places = (
        rows.where(F.col("size") > 0)
        .groupBy("source", "doc_id", "text_key")
        .agg(F.sum("size").alias("words"))
        .withColumn("place", place)
        .withColumn("range", F.shiftright("place", 64 - RANGES.bit_length() + 1))
    )
    inside = Window.partitionBy("source", "range").orderBy("place", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, 0)
    ranges = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        places.groupBy("source", "range").agg(F.sum("words").alias("range_words"))
        .withColumn("offset", F.coalesce(F.sum("range_words").over(ranges), F.lit(0)))
        .select(F.col("source").alias("s"), F.col("range").alias("r"), "offset")
    )
    known = targets.select(F.col("source").alias("t"), "source_size", "target", "budget")
    queued = (
        places.withColumn("until", F.sum("words").over(inside))
        .join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
        .join(known, F.col("source").eqNullSafe(F.col("t")))
        .select(
            "source", "doc_id", "text_key", "place", "words", "budget",
            F.posexplode(
                F.transform(
                    F.sequence(F.lit(0), F.lit(rounds - 1)),
                    lambda k: (k * F.col("source_size") + F.col("offset") + F.col("until")) / F.col("target"),
                )
            ).alias("round", "finish"),
        )
    )
    served = _served(queued)
    taken = served.groupBy(F.col("source").alias("s"), F.col("doc_id").alias("d"), F.col("text_key").alias("k")).agg(
        F.count(F.lit(1)).alias("times")
    )
    same: Column = (
        F.col("source").eqNullSafe(F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k"))
    )
    return (
        rows.join(taken, same, "left")
        .join(known, F.col("source").eqNullSafe(F.col("t")))
        .select(
            "doc_id", "text_key", "source", "size", "source_size", F.col("target").cast("double").alias("target"),
            F.coalesce("times", F.lit(0)).cast("long").alias("times"),
        )
    )


def _served(queued: DataFrame) -> DataFrame:
    """The first of `queued` by finish time that fit the budget, the sum of all targets."""
    early = F.col("finish") <= 1
    step = F.when(early, F.lit(0)).otherwise(F.floor(F.ln("finish") * STEPS) + 1).cast("long")
    binned = queued.withColumn("step", step)
    # A bounded number of rows: finish times are a bounded range of logarithms.
    by_step = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    sums = binned.groupBy("step").agg(F.sum("words").alias("step_words"), F.max("budget").alias("budget")).withColumn(
        "before", F.coalesce(F.sum("step_words").over(by_step), F.lit(0))
    )
    cuts = sums.where((F.col("step") == 0) | (F.col("before") < F.col("budget"))).select(
        F.col("step").alias("b"), "before", (F.col("before") + F.col("step_words") <= F.col("budget")).alias("whole")
    )
    known = binned.join(F.broadcast(cuts), F.col("step") == F.col("b"))
    order = Window.partitionBy("step").orderBy("finish", "source", "place", "doc_id", "text_key", "round")
    last = (
        known.where(~F.col("whole") & (F.col("step") > 0))
        .withColumn("sum", F.col("before") + F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col("sum") <= F.col("budget"))
    )
    names = ["source", "doc_id", "text_key", "round"]
    return known.where(F.col("whole") | (F.col("step") == 0)).select(*names).unionByName(last.select(*names))


def mixed_report(documents: DataFrame) -> DataFrame:
    """The mix as counted words for each document row."""
    return mix(documents).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken")
    )
