import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    rows = [
        (1, "alpha beta gamma delta", "en", "a", 22), (2, "alpha beta  gamma delta", "en", "a", 23), (3, None, "en", "a", None),
        (4, "", None, "b", 0), (5, " \t\n", "de", None, 3), (6, long, "en", "b", len(long)), (7, long, "en", "b", len(long)),
        (8, "x", "fr", "c", 1), (8, "x", "fr", "c", 1), (None, "alpha beta gamma delta", None, None, None), (9, "ÀÉ Straße 中文 😀", "de", "c", 15),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
