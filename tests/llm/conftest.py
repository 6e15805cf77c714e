import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns with clashing names."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog.", "en", "a", 44), (2, "The quick brown fox jumps over the lazy dog.", "en", "a", 44), (3, None, "en", "b", None), (4, "", None, None, 0),
        (5, long, "en", "a", len(long)), (6, "x", "de", "b", 1), (6, "x", "de", "b", 1), (None, "no id here", "en", None, 10), (None, None, None, None, None), (7, " \t\n ", "fr", "c", 5), (8, "é" * 50 + " 你好 😀 𝔘", "fr", "c", 58),
    ]
    df = spark.createDataFrame([(*r, "x", 1, "y", 2, True) for r in rows], DOC + ", score string, size int, target string, chars int, keep boolean")
    return df.cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)
