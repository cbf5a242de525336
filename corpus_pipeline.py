"""A training corpus from raw documents: a chain of the operators of geomill.llm.

Each stage works on the rows that its predecessor kept and returns them with the
columns of `documents`; the last returns the encoded corpus. Every stage is written
as Parquet in the shared folder and read again by the next, so a lost executor costs
no more than a stage. Null texts count as empty, repeated rows are rows of their own
until the join on shingles keeps one of each class, extra columns stay as they are, and
an empty table stays empty; each operator's module states the details.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from geomill.llm import byte_bpe, decontaminate, ngram_join, quality_cnn, suffix_dedup
from geomill.llm.workspace import small_batches, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the byte-level convolutional classifier takes for good; it learns from labelled rows of this stage's input."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_cnn.accepted(docs, quality_cnn.fit(docs, labels, folds=3, held=1))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of texts that links of Jaccard similarity 0.8 connect: the one with the least id."""
    small_batches(spark)
    return ngram_join.one_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut strings of 200 bytes that start more than once out of all texts."""
    small_batches(spark)
    return suffix_dedup.without_repeats(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold ten consecutive words of a benchmark item."""
    small_batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the digests of the ids and of what they decode to."""
    small_batches(spark)
    return byte_bpe.bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeated_strings), ("benchmark decontamination", decontaminated), ("byte-level BPE", encoded)]

#: The classifier and the joins are not expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
