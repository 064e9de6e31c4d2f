"""The queries of the corpus operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe, decontamination, exact_dedup, hard_negatives, language_id, license_scan, near_join, pii, quality, simhash, spelling, substring_dedup, suffix_dedup)
from .common import table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op5_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op6_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(docs))


def op8_cover_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op9_bayes_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op11_kronecker_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), vec_id % 100 == 0)


def op12_simhash_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_spelling_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_crf": op1_language_crf,
    "op2_bpe_codec": op2_bpe_codec,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_license_diagonals": op5_license_diagonals,
    "op6_positional_index": op6_positional_index,
    "op7_pii_skip_chain": op7_pii_skip_chain,
    "op8_cover_anchors": op8_cover_anchors,
    "op9_bayes_near_join": op9_bayes_near_join,
    "op10_quality_subwords": op10_quality_subwords,
    "op11_kronecker_negatives": op11_kronecker_negatives,
    "op12_simhash_slices": op12_simhash_slices,
    "op13_spelling_composition": op13_spelling_composition,
}
