"""A corpus pipeline of five stages over ``documents``, each one of the text operators.

Quality rules drop documents, the n-gram join (five words, similarity 0.8) keeps the first of each
group of near copies, suffix dedup cuts passages that repeat, decontamination drops documents that
hold benchmark items, and packing turns what is left into token sequences.  Every stage is written
to the shared folder and read again, so a lost executor costs one stage's tasks at most; a stage's
input is removed once its output stands.

Defined results for odd input: rows with a null, empty or blank text fail the quality rules; rows
without a doc_id are handled like others and lose to equal texts that have one; of equal rows one
stays; an empty table gives an empty table; extra columns, whatever their names, reach the last
stage, whose rows have packing's own columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from parley.llm import decontamination, packing, parity_join, quality_rules, suffix_dedup
from parley.llm.storage import drop, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_clean(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return parity_join.keep_first(docs, parity_join.Rule(k=5, percent=80))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.clean(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeats),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]

#: SQL cannot express the token packing at the end.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        out = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if n:
            drop(docs)
        docs = out
    return docs
