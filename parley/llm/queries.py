"""The queries of the text operators: each applies one to its whole table and derives its columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parley.llm import compression_toxicity, decontamination, labelled, license_scan, merkle_manifest, packing, parity_join, prefix_bpe, quality_model, quality_rules, ranked_search, sentence_spans, sharding, suffix_dedup


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op2_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.hits(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op3_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.join(documents(spark, sf_dir), parity_join.Rule(k=3, percent=90))


def op4_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(documents(spark, sf_dir), keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality_model.fit(docs, labels(spark, sf_dir), "quality", labelled.fold("doc_id", 4) != 2)
    return quality_model.score(docs, model, folds=4, held=2)


def op7_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = compression_toxicity.fit(docs, labels(spark, sf_dir), "toxic", labelled.fold("doc_id", 3) != 1)
    return compression_toxicity.score(docs, model, folds=3, held=1)


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.digest(sentence_spans.dedup(documents(spark, sf_dir)))


def op9_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(documents(spark, sf_dir))


def op10_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), shards=16)


def op11_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return prefix_bpe.digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_scan.oracle_sql(), "op5_quality_rules": quality_rules.oracle_sql(), "op12_threshold_search": ranked_search.oracle_sql(), "op13_merkle_manifest": merkle_manifest.oracle_sql()}
