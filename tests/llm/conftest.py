import pytest

LONG_WORD = "x" * 150_000
LONG_TEXT = " ".join(f"w{i % 997}" for i in range(60_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, a doc_id of two texts, and columns of names that operators use inside."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "a"),
        (1, "the quick brown fox jumps over the lazy dog again and again", "a"),
        (2, "the quick brown fox jumps over the lazy dog again and again", None),
        (3, None, "a"),
        (4, "", "b"),
        (5, " \n\t ", "b"),
        (6, LONG_WORD, "b"),
        (7, LONG_TEXT, "b"),
        (8, LONG_TEXT, "b"),
        (None, "the quick brown fox jumps over the lazy dog again and again", "a"),
        (None, "a row without a name\nand a second line", None),
        (9, "one", "a"),
        (9, "another text of the same document\nand a second line", "a"),
        (10, "é\x0bÀ ß 漢字 \U0001f600\nAnd a second line", "a"),
    ]
    full = [(d, t, s, "en", len(t or ""), "k", "h", "c", "o", 1.0, [1], "x") for d, t, s in rows]
    return spark.createDataFrame(full, "doc_id bigint, text string, source string, lang string, n_chars bigint, key string, h string, copy string, order_key string, score double, bands array<int>, doc string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
