import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, a long text, ties, repeated rows, and columns whose names clash with the operators' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, h long, size long, rank long, fp long, bucket long"
    long = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "a"), (4, "one", "en", "b"), (5, long, "de", "b"), (6, "same text here", "fr", None),
        (7, "same  text here", "fr", "c"), (8, "same text here", "fr", "c"), (8, "same text here", "fr", "c"), (9, "Ünï çödé 日本 🙂 text", "es", "c"), (None, "no id", None, "d"),
    ]
    return spark.createDataFrame([(*r, 0, 1, 2, 3, 4, 5) for r in rows], schema)


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return spark.createDataFrame([], odd_docs.schema)
