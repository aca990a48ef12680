import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _text string, _id long, kept boolean, label string, score double"


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with NULLs in every column, empty and very long texts, ties, repeated rows and clashing column names."""
    long_text = "\n".join(f"line number {i} of a very long text with some words" for i in range(4000))
    texts = ["same text here\nshared line", "same text here\nshared line", "", None, "  \t", long_text, "shared line\n\nother line",
             "word", "Ünïcödé ß 日本語 text\r\nshared line ", "a" * 20000, "1234 5678 !!", "tail \n"]
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or ""), "clash", 7, True, "x", 0.5) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, "same text here\nshared line", None, None, None, None, None, None, None, None), (None, None) + (None,) * 8]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], T._parse_datatype_string(DOCS))
