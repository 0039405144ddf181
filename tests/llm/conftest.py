import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use themselves
    T.StructField("score", T.StringType()), T.StructField("class_id", T.StringType()), T.StructField("words", T.StringType()),
])
PROSE = "the quick brown fox went over the hill and met a lazy dog who slept near the old stone wall all day long. "


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows."""
    long = " ".join(f"word{i % 997}" for i in range(30_000)) + "\n" + "x" * 50_000
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 3), (4, PROSE * 5, "en", "a", None),
        (5, PROSE * 5, "en", "b", None), (6, long, "en", "a", len(long)), (7, "12345 !!! 67", None, "b", 12),
        (8, "für die Straße über den Fluss und das Öl " * 9, "de", None, None), (8, "für die Straße über den Fluss und das Öl " * 9, "de", None, None),
        (None, PROSE * 5, None, "a", None), (9, "mail jo@ex.org or call +1 (017) 555-7713 now 😀 日本", "en", "a", 1), (10, "one two", "en", "a", 7),
    ]
    return [(*r, "s", "c", "w") for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)
