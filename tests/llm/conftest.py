import pytest

#: Nulls, blanks, one very long text, ties, repeated rows, and a column by the name of most that operators add.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from here today", "en"),
    (2, "The quick brown fox jumps over the lazy dog and runs far away from here today", "en"),
    (2, "The quick brown fox jumps over the lazy dog and runs far away from here today", "en"),
    (3, None, None),
    (4, "", "en"),
    (5, " \n\t ", None),
    (6, "one two three", "en"),
    (7, "ONE two THREE", "en"),
    (8, "longtext " * 30_000, "en"),
    (9, "é日本語😀 ??? 12345", "xx"),
    (None, "the quick brown fox jumps over the lazy dog and runs far away from here today", None),
    (10, "x" * 60_000, "en"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, lang, "batch", 7.5) for i, t, lang in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, batch string, score double")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
