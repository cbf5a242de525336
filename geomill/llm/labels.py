"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int, most_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label) of at most `rows` labelled documents outside the held-out fold, first by a hash of the id.

    This is the one bounded sample an operator may learn from. Documents over
    `most_bytes` are not learnt from, so that the sample's bytes are bounded too; they
    are scored like all others. An id with several labels counts with the largest one.
    """
    label_of = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).alias("label"))
    own = label_of.filter(fold(id_col, folds) != held).orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(rows)
    few = docs.select(id_col, text_col).join(F.broadcast(own), id_col).filter(F.length(text_col) <= most_bytes)
    return few.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), F.col("label").cast("int").alias("label")).orderBy(F.xxhash64(F.col("id").cast("string")), "id", "text").limit(rows)
