import pytest

WIDE = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, n_words string, spans string, node string, toxicity string, perplexity string, pieces string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, columns whose names clash."""
    long = "alpha beta gamma delta epsilon zeta " * 20000
    rows = [
        (0, None, "en"),
        (1, "", "en"),
        (2, " \t\n ", None),
        (3, "one", "en"),
        (4, "one", "en"),
        (5, long, "en"),
        (6, "x" * 300000, "de"),
        (7, "the quick brown fox jumps over the lazy dog", "en"),
        (7, "the quick brown fox jumps over the lazy dog", "en"),
        (8, "der schnelle braune Fuchs springt über den faulen Hund", "de"),
        (None, "the quick brown fox jumps over the lazy dog", "en"),
        (9, "日本語 テキスト \U0001f600 ▁ \x00", None),
        (10, None, None),
    ]
    return spark.createDataFrame([(i, t, g, "s", len(t or ""), *["old"] * 8) for i, t, g in rows], WIDE)


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(7, 1, 0), (3, 0, 1), (8, 1, 0), (None, 1, 1), (7, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
