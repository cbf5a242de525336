import pytest
from pyspark.sql import types as T

LONG = "word " * 3000
PASSAGE = " ".join(f"passage{i} shared" for i in range(40))


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@pytest.fixture(scope="session")
def items(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, short and long texts, ties, repeated rows, and extra columns with clashing names."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("key", T.StringType()), T.StructField("score", T.StringType()), T.StructField("n_tokens", T.StringType()), T.StructField("segment", T.StringType()), T.StructField("label", T.StringType())])
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, PASSAGE), (6, "before " + PASSAGE + " after"), (7, PASSAGE), (7, PASSAGE), (None, "a text of a row without an id, of some words"), (8, "日本語 テキスト\n😀 é"), (9, "one two three"), (10, "one two three"), (11, "aaaa" * 500), (12, "\x00 nul")]
    return spark.createDataFrame([(i, t, None, "x", None, "s", "l") for i, t in texts], schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
