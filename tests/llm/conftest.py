import pytest
from pyspark.sql import functions as F

LONG = "word " * 30_000


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns whose names clash with results."""
    rows = [
        (1, "one two three four five six seven eight nine ten", "en", "s", 5), (1, "one two three four five six seven eight nine ten", "en", "s", 5), (2, "", "en", "s", 0), (3, None, None, None, None),
        (None, "one two three four five six", "en", None, 3), (4, LONG, "en", "s", 9), (5, "  \n\t ", None, "s", 1), (6, "12345 !!! 67", None, "s", 1), (7, "One TWO three four five six seven eight nine ten", "fr", "s", 5),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in ("score", "n_tokens", "spans", "component_id", "labels", "kept", "n_words", "hub", "digest", "item_id", "place", "copies", "low", "words", "content")})


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
