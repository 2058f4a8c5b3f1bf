import pytest


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def odd_documents(spark):
    """Nulls in every column, empty and blank texts, ties, repeated rows, one long text, extra columns with names used inside."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (1, None, "en", "s", 3, "x", 1), (2, "", None, None, None, None, None), (3, " \t\n", "de", "s", 1, "x", 1), (4, "one two", "en", "s", 7, "y", 2),
        (5, "one two", "en", "s", 7, "y", 2), (5, "one two", "en", "s", 7, "y", 2), (None, "one two three four", "en", "s", 7, "y", 2), (6, long, "en", "s", 9, "z", 3), (7, long + " x", "en", "s", 9, "z", 3),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, rid int")
