import pytest

from pyspark.sql import functions as F
from pyspark.sql import types as T

PASSAGE = " ".join(f"passage{k} of words" for k in range(40))

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows and lone characters."""
    long = " ".join(f"w{k % 977} x{k}" for k in range(40000))
    rows = [
        (1, None, "en", "s", None), (2, "", "en", "s", 0), (3, " \n\t ", None, "s", 4), (4, "one", "en", None, 3), (5, long, "en", "s", len(long)),
        (6, f"{PASSAGE}\n\nend", "en", "s", 1), (7, f"{PASSAGE}\n\nend", "en", "s", 1), (7, f"{PASSAGE}\n\nend", "en", "s", 1), (8, f"Before it. {PASSAGE.upper()} After.", "xx", "s", 1),
        (9, "\u6f22\u5b57 \U0001f600 caf\u00e9 \u0130stanbul", "zh", "s", 1), (None, "no number here at all, but words", "en", "s", 1), (10, "a" * 30000, "en", "s", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def crowded(odd):
    """The same with extra columns whose names the operators use inside."""
    names = ["n_words", "spans", "items", "id", "k1", "head", "tokens", "quality", "pii", "licences", "w", "s", "n"]
    return odd.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
