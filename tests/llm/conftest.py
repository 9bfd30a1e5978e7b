import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, mark int, frag string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, and names that the operators use themselves."""
    long = "The quick brown fox jumps over the lazy dog and runs away. " * 400
    rows = [
        (1, "Hello there, dear reader of texts.", "en", "a", 34, 1, "x"),
        (1, "Hello there, dear reader of texts.", "en", "a", 34, 1, "x"),
        (2, None, None, None, None, None, None),
        (None, "Hello there, dear reader of texts.", "en", "b", 34, 2, "y"),
        (None, None, None, None, None, None, None),
        (3, "", "en", "a", 0, 3, "z"),
        (4, " \n\t ", "fr", None, 4, None, "z"),
        (5, long, "en", "a", len(long), 5, None),
        (6, long + "More.", "en", "a", len(long) + 5, 5, None),
        (7, "été à la plage, où êtes-vous?\n\nIci: a.b@c.de et +1 (415) 555-0132 ou 10.0.0.1 ou 4111 1111 1111 1111", "fr", "c", 90, 7, None),
        (8, "12345 67890", None, "c", 11, 8, None),
        (9, "x" * 5000, "en", "d", 5000, 9, None),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
