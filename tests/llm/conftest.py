import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, fp long, score double, spans string"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, and extra columns that clash with results."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank. " * 12, "en", "a"),
        (2, "The quick brown fox jumps over the lazy dog near the river bank. " * 12, "en", "a"),
        (2, "The quick brown fox jumps over the lazy dog near the river bank. " * 12, "en", "a"),
        (3, "", "en", "b"),
        (4, None, None, None),
        (None, "no id here but some words to read", "en", None),
        (None, None, None, "c"),
        (5, "   \n\t ", None, "c"),
        (6, "été œuf \U0001f600 Σίσυφος İstanbul 123 456", "fr", "c"),
        (7, "ab " * 30_000, "en", "a"),
        (8, "x", "de", "b"),
    ]
    return spark.createDataFrame([(*r, None, 1, 2, 3, 0.5, "s") for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
