import pytest

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 70),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 70),
    (3, "", "en", "b", 0),
    (4, None, None, None, None),
    (5, "   \n\t ", "de", "b", 5),
    (6, "word " * 3000, "en", "a", 15000),
    (7, "é ß 日本語 😀 <|endoftext|> don't  stop\n\nNow!", "xx", "c", 40),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 70),
    (None, "no id here but some words that make up a line of text", "en", "c", 50),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows."""
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def clashing(odd):
    """More columns, named as operators might name their own."""
    from pyspark.sql import functions as F

    out = odd
    for name in ("doc", "words", "size", "key", "lines", "node", "bucket", "measured", "failed", "label", "number", "copies", "n_dropped", "row", "host", "rank"):
        out = out.withColumn(name, F.lit("x"))
    return out


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").cache()
