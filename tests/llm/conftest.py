import pytest

SMALL = "/root/testdata/sf0.001"

EDGE = [
    (1, "Hello there, it's  a test.\n\nNew line", "en", "a", 10),
    (2, None, "en", "a", 0),
    (3, "", None, None, 0),
    (4, "   \t\n ", "de", "b", 6),
    (5, "HELLO there, it's  a test.\n\nnew line", "en", None, 10),
    (5, "HELLO there, it's  a test.\n\nnew line", "en", None, 10),
    (None, "x" * 5000 + " <|endoftext|> ÀÉ　  é   z " + "long words here " * 3000, None, "c", 1),
    (7, "emoji 😀😀 中文 字 tab\tsep\r\n 12345 '’s 'S it'LL", "fr", "b", 5),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with names that operators also add."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit("mine") for c in ("n_tokens", "size", "h", "kept", "hash", "part")})


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
