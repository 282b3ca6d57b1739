import pytest
from pyspark.sql import Row

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, _count string"


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and columns of clashing names."""
    long = " ".join(f"word{i % 997} tok{i % 31}" for i in range(30_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 1, 0.5, "x"),
        (2, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 1, 0.5, "x"),
        (2, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 1, 0.5, "x"),
        (3, None, "de", "b", None, None, None),
        (4, "", None, "b", 0, None, "y"),
        (5, " \t\n ", "de", None, 0, None, "y"),
        (6, long, "en", None, 1, 1.0, "y"),
        (None, "der schnelle braune fuchs springt über den faulen hund", "de", "c", 1, 0.0, "z"),
        (8, "Ünï ¡ñandú! 12345 ...", "es", "", 1, 0.0, "z"),
        (9, "der schnelle braune fuchs springt über den faulen hund", "de", "c", 1, 0.0, "z"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.filter("false")


def rows_of(df) -> list[Row]:
    return sorted(df.collect(), key=repr)
