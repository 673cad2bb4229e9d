import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = DOCS + ", hub string, print string, sig string, q_host string, word string, m_rate string, copy string, shuffle_key string, path string"


@pytest.fixture(scope="session")
def real(spark):
    """The smallest table of documents, whole."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").persist()


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet").persist()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, and extra columns whose names clash."""
    words = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    rows = [
        (1, None, "en", "a", None), (2, "", "en", None, 0), (3, " \n\t ", None, "a", 3), (4, words, "en", "a", len(words)), (5, "one two three.", "en", "b", 14), (5, "one two three.", "en", "b", 14),
        (6, "ONE two three.", "fr", "b", 14), (None, "lost id. Five words are here now!", "en", "b", 30), (7, "'s don't \x00 <|endoftext|> İΣ 日本 12345", None, None, None), (-8, words + " more", "en", "a", None),
    ]
    return spark.createDataFrame([(*r, "h", "p", "s", "n", "w", "m", "c", "k", "t") for r in rows], EXTRA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], EXTRA)
