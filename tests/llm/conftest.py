import pandas as pd
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls, empty and one-word texts, repeated rows, ties, a long text, and copies.
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away today", "en", "a", 1),
    (2, "the quick brown fox jumps over the lazy dog and runs far away today", "en", "b", 1),
    (3, None, "en", "a", 0),
    (4, "", None, None, 0),
    (5, "word", "en", "a", 4),
    (5, "word", "en", "a", 4),
    (6, " \t\n ", "de", "b", 4),
    (7, "der schnelle braune fuchs springt über den faulen hund und läuft weit weg", "de", "b", 1),
    (8, "12345 !!! ###", None, "c", 1),
    (None, "a text without an id that has some words in it and more", "en", "a", 1),
    (9, "line one of it\nline two of it\nline one of it\n\nline one of it here", "en", "c", 1),
    (10, "lorem ipsum dolor sit amet " * 4000, "en", "c", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with extra columns whose names the operators use."""
    from pyspark.sql import functions as F

    d = spark.createDataFrame(ROWS, SCHEMA)
    return d.withColumns({"size": F.lit(1), "score": F.lit("x"), "k0": F.lit(2), "body": F.lit("y"), "sig": F.lit(3), "bin": F.lit(4), "w": F.lit(5)})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(sf):
    return pd.read_parquet(f"{sf}/documents.parquet")
