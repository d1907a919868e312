"""The registered queries of the operators: each over its whole table, with production parameters.

The queries without SQL in `oracles.py` are held against brute force by the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelog.llm import alignment, chat, jaccard, languages, leaks, licenses, lm, minhash, mixing, negatives, quality, secrets, toxicity
from stridelog.llm.oracles import ORACLES as ORACLES
from stridelog.llm.text import rows_of, table


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    added = rows_of([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], ("conv_id", "turn", "role", "text"), spark)
    return chat.chat_report(told.unionByName(added))


def op2_ngram_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"), n=3, percent=90).drop("set_key")


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op5_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op6_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.language_report(table(spark, sf_dir, "documents"))


def op7_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_report(table(spark, sf_dir, "documents"))


def op8_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.language_model_scores(table(spark, sf_dir, "documents"))


def op9_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op10_toxic_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_pair_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)


def op13_minhash_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_classes(table(spark, sf_dir, "documents"), n=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_chat_windows, op2_ngram_trie_join, op3_benchmark_leaks, op4_license_scan, op5_quality_divergence, op6_language_ppm, op7_fair_queue_mix, op8_attention_scores, op9_secret_ownership, op10_toxic_lexicon, op11_pair_bitmaps, op12_hard_negatives, op13_minhash_stars)
}
