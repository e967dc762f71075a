import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, and extra columns with clashing names."""
    long = " ".join(f"word{k % 977}" for k in range(30_000))
    rows = [
        (1, "the cat sat on the mat and saw the dog run away", "en", "s", 5), (1, "the cat sat on the mat and saw the dog run away", "en", "s", 5),
        (2, None, None, None, None), (3, "", "en", "s", 0), (4, " \n\t ", "fr", "s", 4), (5, long, "en", "s", len(long)), (6, long, "en", "s", len(long)),
        (None, "le chat est sur la table avec le chien", "fr", None, 3), (None, None, None, None, None), (7, "12345 !!", None, "s", 8), (8, "é" * 700, "fr", "s", 700), (9, "\U0001f600 x" * 300, "en", "s", 900),
    ]
    df = spark.createDataFrame(rows, DOCS)
    clash = ["b", "t", "fp", "item", "name", "whole", "score", "a", "p0", "kept", "m", "x", "n_bytes", "language", "offending"]
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit(k).alias(n) for k, n in enumerate(clash)))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def some_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
