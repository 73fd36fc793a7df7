import pytest
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{i}" for i in range(60))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids, texts and labels, empty and very long texts, repeated rows, and columns named like results."""
    very_long = " ".join(f"x{i * 7919 % 100003}" for i in range(60_000))
    rows = [
        (1, LONG, "en", "a", 1), (2, LONG, "en", "a", 1), (2, LONG, "en", "a", 1),  # copies and a repeated row
        (3, LONG.replace("w30", "v30"), "en", "a", 1),  # a near copy
        (4, None, None, None, None), (5, "", "en", "", 0), (6, " \n\t", None, "b", 3), (7, "123 456 !!", "de", "b", 1),
        (8, very_long, "de", "b", 1), (None, "null id text stays", "de", None, 1), (9, "é漢字 👍🏽 <|endoftext|> x", None, "b", 1),
        (10, "one two", "en", "c", 1), (10, "three four", "en", "c", 1),  # one id, two texts
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({"score": F.lit("s"), "hash": F.lit(1), "doc": F.lit("d"), "remaining": F.lit(0), "labels": F.array(F.lit(1)), "_c0": F.lit(2)})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
