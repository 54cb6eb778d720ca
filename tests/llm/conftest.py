import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, ids string, row string, stats string, first long, label string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, white and very long texts, repeated rows, and columns named like the operators' own."""
    long = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
    extra = ("a", None, "b", "c", "d", 5, "e")
    rows = [
        (1, "one two three four five six", "en", "s1", 27, *extra), (2, "one  two three\tfour five six", "en", "s1", 27, *extra),
        (3, None, "en", "s1", None, *extra), (4, "", None, "s2", 0, *extra), (5, " \n ", "en", None, 3, *extra),
        (None, "one two three four five six", None, None, None, *extra), (None, None, None, None, None, *([None] * 7)),
        (6, long, "en", "s1", len(long), *extra), (7, "x" * 200_000, "en", "s3", 200_000, *extra),
        (8, "same row", "en", "s2", 8, *extra), (8, "same row", "en", "s2", 8, *extra), (9, "▁ mark \U0001F600 é", "fr", "s3", 9, *extra),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
