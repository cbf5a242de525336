"""One query for each operator of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from geomill.llm import bloom_lines, byte_bpe, centroid_clusters, decontaminate, line_dedup, merkle, ngram_join, quality_cnn, quality_rules, suffix_dedup, token_count, toxicity, url_filter
from geomill.llm.workspace import small_batches

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.fit(docs, labels, folds=5, held=0), folds=5, held=0)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.bpe_round_trip(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_cnn.score(docs, quality_cnn.fit(docs, labels, folds=3, held=1), folds=3, held=1)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.without_repeated_units(table(spark, sf_dir, "documents")))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.summary(*centroid_clusters.clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op12_bloom_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lines.digest(bloom_lines.without_frequent_lines(table(spark, sf_dir, "documents")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_proof(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_token_counts, op3_decontamination, op4_byte_bpe, op5_quality_classifier, op6_quality_rules, op7_url_filter, op8_ngram_join, op9_line_dedup, op10_suffix_dedup, op11_centroid_clusters, op12_bloom_lines, op13_merkle_manifest)}
ORACLE_SQL: dict[str, str] = {"op9_line_dedup": line_dedup.ORACLE_SQL, "op11_centroid_clusters": centroid_clusters.ORACLE_SQL, "op12_bloom_lines": bloom_lines.ORACLE_SQL, "op13_merkle_manifest": merkle.ORACLE_SQL}
