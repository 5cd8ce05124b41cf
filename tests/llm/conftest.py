import pytest

from shelfline.llm.common import configure


@pytest.fixture(scope="session")
def llm(spark):
    return configure(spark)


# doc_id, text, lang, source, n_chars: nulls in every column, empty and long texts, repeated ids,
# repeated rows, and columns whose names the operators use themselves.
LONG = "alpha beta gamma delta " * 40_000
ROWS = [
    (1, "The cat sat on the mat today again", "en", "a", 3),
    (2, "THE CAT sat on the mat today again", "en", "a", 3),
    (2, "the cat sat on the mat today again", None, None, None),
    (3, "", "en", "b", 0),
    (4, None, "en", "b", None),
    (None, "no id here but some words to count", "en", "b", 1),
    (None, None, None, None, None),
    (5, "five words of text here", "en", "é", 1),
    (5, "five words of text here", "en", "é", 1),
    (6, LONG, "en", "a", 1),
    (7, LONG, "en", "b", 1),
    (8, " \t\n ", "en", "c", 1),
    (9, "Éa two\x00 <|endoftext|> 日本語 'll don't  x\n\n  y 123", "en", "c", 1),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = {
    "ids": "x", "score": 1.5, "name": "n", "size": 7, "copies": 2, "taken": 9, "n": 1, "set_id": 4,
    "component": 1, "sketch": "s", "_text": "t", "_row": 1, "u": 0.5, "f": 0.1, "base": 1, "extra": 1,
    "decoded": "d", "bucket": 2, "text_hash": 5, "label": 3, "part": 1,
}


@pytest.fixture(scope="session")
def odd_docs(llm):
    from pyspark.sql import functions as F

    return llm.createDataFrame(ROWS, SCHEMA).withColumns({k: F.lit(v) for k, v in CLASHING.items()})


@pytest.fixture(scope="session")
def no_docs(llm):
    return llm.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(llm):
    return llm.read.parquet("/root/testdata/sf0.001/documents.parquet")
