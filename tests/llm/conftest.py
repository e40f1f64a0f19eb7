from __future__ import annotations

import pytest

CLASHING = {
    "ids": "1", "fp": "2", "score": "3", "spans": "4", "words": "5", "line": "6", "pos": "7", "doc": "8", "_doc": "9", "_gone": "10", "gone": "11",
    "_score": "12", "n": "13", "root": "14", "label": "15", "_dropped_id": "16",
}


@pytest.fixture
def docs(spark):
    """A documents table of (id, text) pairs, with columns that have the names operators use inside."""

    def build(*rows):
        columns = ", ".join(f"'{v}' AS {k}" for k, v in CLASHING.items())
        df = spark.createDataFrame(list(rows), "doc_id long, text string")
        return df.selectExpr("doc_id", "text", columns.split(", ")[0], *columns.split(", ")[1:])

    return build


@pytest.fixture
def none(docs):
    return docs((1, "x")).limit(0)


@pytest.fixture
def odd(docs):
    """Nulls, empty, blank and long texts, repeated rows."""
    long = "alpha beta gamma delta epsilon " * 4000
    return docs(
        (None, "a text without an id, somewhere"), (1, None), (2, ""), (3, " \n\t "), (4, long), (5, long), (6, "one\ntwo\n\none"), (6, "one\ntwo\n\none"),
        (7, "x" * 3000), (8, "é𝒳ß ﷐ ￿ end"),
    )
