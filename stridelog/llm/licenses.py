"""License scan by diagonal voting.

Every two consecutive words of a document are hashed and joined to the places of the same hash in the
license templates. A hit at word `i` of the document and word `j` of a template votes for the
diagonal `i - j`, the place where the template would have to start. Votes are kept as a bit per
template word, so a diagonal is one long whatever its number of hits. Neighbouring diagonals of one
template (words left out or put in) are merged, up to a width, and are a candidate if enough of the
template's bits are set. A candidate is verified in order: the votes say which words of the
document, from the first diagonal on, stand for which words of the template, and the longest sequence of
them that keeps the order of both must cover enough of the template. A base phrase counts where one single
diagonal has all its bits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridelog.llm.text import bigrams, rows_of, text_of, words_of

#: Between words of a license text, once it is lower case: ASCII that is no letter and no digit.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a template: a bit each in a long, and room for a carry.
MOST_WORDS = 62


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    #: Counts only where all its words stand next to each other.
    exact: bool = False


# The base phrases and their labels.
BASE = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
)

# Opening lines of widely used licenses, found also when a few words differ.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    Template("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
)


def license_spans(
    documents: DataFrame,
    templates: tuple[Template, ...] = BASE + NOTICES,
    reach: int = 8,
    least: float = 0.7,
) -> DataFrame:
    """One row per document row: doc_id, text_key, n_words and `spans`, an array of (label, exact, start, n, cover).

    `start` is the word the span begins at, `n` the template's words. Diagonals from one to `reach` words
    after it are merged. An inexact template is found where the merged diagonals have the part `least`
    of its word pairs, and `cover`, the part of its words that follow each other in the document as they do in
    the template, is `least` or more; a word counts where it stands beside the same word as in the template.
    Of spans of a template that begin at most `reach` words apart the one with the largest cover stays, then
    the first. A null text has no words; a null doc_id stays null; rows that are equal in doc_id and text get equal
    results; other columns are not read. Templates need two to MOST_WORDS words.
    """
    if any(not 2 <= len(t.words.split()) <= MOST_WORDS for t in templates):
        raise ValueError(f"templates need two to {MOST_WORDS} words")
    spark = documents.sparkSession
    # The Kelvin sign is the one letter outside ASCII whose lower case is inside.
    lower = F.lower(F.replace(text_of(), F.lit("\u212a"), F.lit("\ue000")))
    words = F.array_remove(F.split(lower, GAPS), "")
    rows = documents.select("doc_id", F.xxhash64(text_of()).alias("text_key"), words.alias("words"))

    grams = _template_grams(spark, templates)
    hits = rows.select("doc_id", "text_key", F.posexplode(bigrams(F.col("words"))).alias("at", "gram")).join(
        # As many rows as the given templates have words.
        F.broadcast(grams),
        "gram",
    )
    votes = hits.groupBy("doc_id", "text_key", "template", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.bit_or(F.expr("shiftleft(1L, place)")).alias("bits"),
        *(F.first(c).alias(c) for c in ("label", "exact", "n")),
    )
    # An exact template keeps every full diagonal for itself.
    votes = votes.where(~F.col("exact") | (F.bit_count("bits") == F.col("n") - 1))
    along = Window.partitionBy("doc_id", "text_key", "template").orderBy("diagonal")
    near = along.rangeBetween(0, reach)
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > F.lit(reach), F.lit(True))
    found = (
        votes.withColumn("merged", F.when(F.col("exact"), F.col("bits")).otherwise(F.bit_or("bits").over(near)))
        # At most reach + 1 diagonals.
        .withColumn("votes", F.when(~F.col("exact"), F.collect_list(F.struct("diagonal", "bits")).over(near)))
        .where(F.bit_count("merged") >= F.lit(least) * (F.col("n") - 1))
        .withColumn("cover", F.when(F.col("exact"), F.lit(1.0)).otherwise(_in_order(reach) / F.col("n")))
        .where(F.col("cover") >= F.lit(least))
        .withColumn("begins", F.when(F.col("exact"), F.lit(1)).otherwise(apart.cast("int")))
        .withColumn("run", F.sum("begins").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "text_key", "template", "run")
        .agg(
            F.max_by(F.struct(F.col("diagonal").alias("start"), "cover"), F.struct("cover", -F.col("diagonal"))).alias("best"),
            *(F.first(c).alias(c) for c in ("label", "exact", "n")),
        )
        .select("doc_id", "text_key", "label", "exact", "n", "best.*")
    )
    spans = found.groupBy("doc_id", "text_key").agg(
        F.sort_array(
            F.collect_list(
                F.struct(F.greatest("start", F.lit(0)).alias("start"), "label", "exact", "n", "cover")
            )
        ).alias("spans")
    )
    named = spans.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "spans")
    return (
        rows.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"))
        .join(named, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left")
        .select(
            "doc_id",
            "text_key",
            "n_words",
            F.coalesce("spans", F.expr("array()").cast(spans.schema["spans"].dataType)).alias("spans"),
        )
    )


def _in_order(reach: int) -> Column:
    """The length of the longest common sequence of the template and the words that have voted, bit by bit.

    For every word of the document the template's words that it stands for are the bits of a long; one
    addition carries the table of the longest common sequences on by a word, and its zeros are the length
    (the bit-vector algorithm by Crochemore and Hyyro).
    """
    all_bits = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("n")) - 1

    def stands_for(step: Column) -> Column:
        def of(vote):
            place = F.col("diagonal") + step - vote.diagonal
            # A set bit is a pair of words, so both of them.
            both = vote.bits.bitwiseOR(F.shiftleft(vote.bits, 1))
            own = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(place, F.lit(0)))
            return F.when((place >= 0) & (place < F.col("n")), both.bitwiseAND(own)).otherwise(F.lit(0).cast("long"))

        return F.aggregate("votes", F.lit(0).cast("long"), lambda m, vote: m.bitwiseOR(of(vote)))

    def carried(v: Column, mask: Column) -> Column:
        u = v.bitwiseAND(mask)
        return (v + u).bitwiseOR(v - u).bitwiseAND(all_bits)

    masks = F.transform(F.sequence(F.lit(0), F.col("n") + F.lit(reach)), stands_for)
    return F.col("n") - F.bit_count(F.aggregate(masks, all_bits, carried))


def _template_grams(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    rows = [(number, t.label, t.exact, t.words) for number, t in enumerate(templates)]
    table = rows_of(rows, ("template", "label", "exact", "text"), spark).withColumn("words", words_of(F.col("text")))
    return table.select(
        "template", "label", "exact", F.size("words").alias("n"), F.posexplode(bigrams(F.col("words"))).alias("place", "gram")
    )


def license_report(documents: DataFrame) -> DataFrame:
    """The license columns of each document row, from its spans."""
    exact = F.filter("spans", lambda s: s.exact)
    starts = F.transform(exact, lambda s: s.start.cast("long"))

    def labels(spans):
        return F.array_join(F.sort_array(F.array_distinct(F.transform(spans, lambda s: s.label))), ",")

    return license_spans(documents).select(
        "doc_id",
        "n_words",
        F.size(exact).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(exact).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s.cover)), F.lit(0.0)).cast("double").alias("score"),
    )
