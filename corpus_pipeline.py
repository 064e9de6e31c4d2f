"""The corpus pipeline: documents pass through ``STAGES`` in order, each written as a table
and read again for the next.

language       drops documents without letters and those whose words look like no language
exact_dedup    keeps, of equal texts, the row with the largest id
near_dedup     keeps one document of each class of near duplicates
decontaminate  drops documents of which one word in twenty is inside a benchmark phrase
tokenize       adds the token ids of each text, and how many there are

The first four return the columns of their input, whatever these are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transeval.llm import bpe, decontamination, exact_dedup, language_id, near_join
from transeval.llm.common import ascii_lower, table, unused, written
from transeval.llm.queries import tokenizer_path
from transeval.llm.shards import NULL_ID

#: Words are clear if the probability of each one's own best language reaches this on average,
#: so a text passes however many languages it mixes.
CLEAR = 0.4


def keyed(docs: DataFrame, digest: Column) -> tuple[DataFrame, str, str]:
    """``docs`` with two columns that name a row: its id (a null one like any other) and a
    digest of its text."""
    key, text = unused(docs, "row_id"), unused(docs, "row_text")
    return docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), text: digest}), key, text


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words are clear; texts without letters go. The field is fitted on the
    documents given, outside its held-out fold."""
    lang, score = unused(docs, "found_lang"), unused(docs, "found_score")
    found = language_id.with_language(docs, language_id.train(docs), lang, score)
    return found.filter((F.col(lang) != language_id.UNKNOWN) & (F.col(score) >= CLEAR)).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal after lower-casing A-Z, the row with the largest id; rows that repeat
    id and text stay as one."""
    found = exact_dedup.exact_duplicates(docs)
    named, key, digest = keyed(docs, F.sha2(ascii_lower(F.col("text")), 256))
    known = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    kept = found.filter("kept").select(known.alias(key), F.col("text_sha256").alias(digest)).distinct()
    # the join leaves equal keys together, so the first of repeated rows is found in place
    nth = unused(named, "nth")
    first = F.row_number().over(Window.partitionBy(key, digest).orderBy(key))
    return named.join(kept, [key, digest], "left_semi").withColumn(nth, first).filter(F.col(nth) == 1).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the smallest id (null ids last, then
    by the text's hash). Documents are told apart by id and text; rows that repeat both stay as
    one, but for those without words, which are near to nothing and all stay."""
    named, key, digest = keyed(docs, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    single, nth = unused(named, "single"), unused(named, "nth")
    chosen = near_join.representatives(docs)
    kept = chosen.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias(key), F.col("text_hash").alias(digest), F.col("single").alias(single))
    first = F.row_number().over(Window.partitionBy(key, digest).orderBy(key))
    return (named.join(kept, [key, digest]).withColumn(nth, first).filter(~F.col(single) | (F.col(nth) == 1)).select(*docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark of ``sf_dir``, told apart by id
    and text."""
    found = decontamination.documents_hit(docs, table(spark, sf_dir, "benchmark"))
    named, key, digest = keyed(docs, F.xxhash64(ascii_lower(F.col("text"))))
    gone = found.filter("contaminated").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias(key), F.col("text_hash").alias(digest))
    return named.join(gone, [key, digest], "left_anti").select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, and the digests of ids and decoded text."""
    return bpe.coded(docs, tokenizer_path())


STAGES = [
    ("language", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontaminate", decontaminate),
    ("tokenize", tokenize),
]

#: SQL can express neither the language stage nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written to the shared
    folder and read again, so a lost executor costs the running stage at most."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return stage_of("tokenize")(spark, docs, sf_dir)


def stage_of(name: str):
    return dict(STAGES)[name]
