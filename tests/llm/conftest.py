import pytest

#: Odd documents that every operator has to take: null and empty texts, blanks, ties, repeated rows, long text.
ODD = [
    (0, None),
    (1, ""),
    (2, " \n\t "),
    (3, "The quick brown fox jumps over the lazy dog near the river bank today, again and again."),
    (4, "The quick brown fox jumps over the lazy dog near the river bank today, again and again."),
    (4, "The quick brown fox jumps over the lazy dog near the river bank today, again and again."),
    (5, "Été déjà vu — naïve café ΣΑΣ 'S it's İstanbul ﬁn <|endoftext|> x\x1cy\xa0z 日本語 мир 12½"),
    (6, "word " * 30_000),
    (None, "a text without an id"),
    (7, "x"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en", None, 5) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, rank int")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
