import pytest
from pyspark.sql import types as T

LONG = "lorem ipsum dolor " * 4000
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # extra columns with names that operators use themselves
    *(T.StructField(c, T.StringType()) for c in ("score", "row", "node", "key", "t", "w", "h", "g", "slot", "piece", "length", "held_out", "kept", "metric", "_row")),
])
TEXTS = [(1, None), (2, ""), (3, "  \n\t "), (None, "a text without an id but with words"), (5, LONG), (6, LONG), (7, "same text here again"), (7, "same text here again"), (8, "ß É 😀 日本語 <|endoftext|> x"), (9, "\n\n"), (10, "one"), (11, "¡" * 50), (12, "same text here again")]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows, clashing extra columns."""
    rows = [(i, t, None if (i or 0) % 2 else "en", None if (i or 0) % 3 == 0 else "s", None, *(["x"] * 15)) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(5, 1, 1), (5, 0, 0), (None, 1, 1), (7, None, None), (10, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
