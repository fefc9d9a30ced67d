import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators' results have, as extra columns of their input.
CLASHES = ("fp", "kept", "n_lines", "score", "order", "bucket", "row", "hits", "marks", "trusted", "key", "a", "b", "u", "v", "part", "ids", "log_p", "start")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and extra columns with clashing names."""
    long = "word " * 3 + "lorem ipsum dolor sit amet " * 40_000
    data = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t\n ", "en", None, 5), (4, long, "en", "a", len(long)), (5, "same text here for all of us", "en", "a", 28),
        (5, "same text here for all of us", "en", "a", 28), (6, "same text here for all of us", None, "b", None), (None, "a text without a number", "de", "b", 23), (7, "12345 !!! ...", "en", "a", 13),
        (8, "Ünïcödé Straße ÉTÉ naïve 日本語 \x1c \x85 é it's 'S don't 3.14 <|endoftext|> x", "de", "b", 10), (9, "x" * 5000, "fr", "a", 5000), (10, "one\ntwo\nthree", "en", "a", 13),
    ]
    df = spark.createDataFrame(data, SCHEMA)
    for c in CLASHES:
        df = df.selectExpr("*", f"'x' AS {c}")
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def make(spark):
    return lambda texts: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
