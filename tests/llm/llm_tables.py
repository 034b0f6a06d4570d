"""Small tables with everything odd in them, and helpers."""

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the cat and dog ran over a hill while seven birds sang about rain in spring".split()


@pytest.fixture
def odd(spark) -> DataFrame:
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    prose = " ".join(WORDS * 3)
    rows = [
        (1, prose, "en", "a", len(prose)),
        (1, prose, "en", "a", len(prose)),
        (2, prose, "en", None, len(prose)),
        (3, "", "en", "b", 0),
        (4, None, None, "b", None),
        (None, "le chat et le chien", "fr", "c", 19),
        (None, None, None, None, None),
        (5, "12 34 !!", "en", "a", 8),
        (6, "der hund und die katze liefen über den berg", "de", "a", 43),
        (7, " \t\n ", "en", "a", 4),
        (8, "x" * 60_000, "en", "d", 60_000),
        (9, "mot " * 30_000, "fr", "d", 120_000),
        (10, "7" * 40_000, None, "a", 40_000),
        (2**60 + 1, "ein hund", "de", "a", 8),
    ]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture
def none(spark) -> DataFrame:
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture
def clashing(odd) -> DataFrame:
    """Columns whose names the operators use inside."""
    names = "found print row place_ copy_ spans text_hash component block key range guest size target root hash".split()
    return odd.select("*", *[F.lit(n).alias(n) for n in names])


def rows_of(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
