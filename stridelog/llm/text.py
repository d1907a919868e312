"""Column expressions shared by the operators: null-safe texts, words, row keys, row access.

A row of documents is told by its id and a hash of its text, so that rows with the same id or with
the same text never mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Between words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """All words between white space, in order."""
    return F.array_remove(F.split(text, SPACE), "")


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def bigrams(words: Column) -> Column:
    """A 64-bit hash for every two consecutive words; empty below two words."""
    return F.slice(
        F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.xxhash64(a, b)),
        F.lit(1),
        F.greatest(F.size(words) - 1, F.lit(0)),
    )


def rows_of(values: list[tuple], names: tuple[str, ...], spark: SparkSession) -> DataFrame:
    """A small constant table, made of literals."""
    structs = [F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row, strict=True))) for row in values]
    return spark.range(1).select(F.inline(F.array(*structs)))


def trigrams(words: Column) -> Column:
    """A 64-bit hash for every three consecutive words; empty below three words."""
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.xxhash64(a, b))
    triples = F.zip_with(pairs, F.slice(words, F.lit(3), F.size(words)), lambda a, b: F.xxhash64(a, b))
    return F.slice(triples, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))


#: Rows of a few numbers that a broadcast may hold: some tens of megabytes.
BROADCAST_ROWS = 500_000


def sized(narrow: DataFrame) -> DataFrame:
    """A stored or cheap narrow table, to be broadcast if it is counted to be small, else as it is."""
    few = narrow.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(narrow) if few else narrow


def same_row(documents: DataFrame, named: DataFrame) -> Column:
    """Whether a row of documents is the one that columns `llm_id` and `llm_key` of `named` name; documents may have such columns too."""
    text = F.coalesce(documents["text"].cast("string"), F.lit(""))
    return documents["doc_id"].eqNullSafe(named["llm_id"]) & (F.xxhash64(text) == named["llm_key"])
