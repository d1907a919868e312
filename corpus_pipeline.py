"""From raw documents to a training mix: toxic documents, near duplicates, benchmark passages and secrets go, then sources are mixed.

Each stage takes the rows that the one before it kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stridelog.llm import jaccard, leaks, mixing, secrets, toxicity
from stridelog.llm.text import table
from stridelog.session import fresh_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labelled rows, does not find toxic."""
    lexicon = toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, lexicon)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by sets of five-word shingles with a similarity of 0.8 or more, the smallest doc_id."""
    return jaccard.one_of_each(docs, n=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return leaks.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a live-looking credential; examples that many owners share do not count."""
    return secrets.without_live_secrets(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document that is taken, with how often, its size, and its source's target."""
    return mixing.mix(docs).where("times > 0").select("doc_id", "source", "size", "source_size", "target", "times")


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", one_of_near_duplicates),
    ("benchmark_decontamination", without_benchmark),
    ("secret_scans", without_secrets),
    ("source_mixing", mixed_sources),
]

#: SQL cannot express the learned lexicon, the tree join, the fingerprints and the hash order of the mix.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
