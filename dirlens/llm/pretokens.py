"""Texts cut into the pieces that a tokenizer looks at on their own."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ends a piece where Spark applies the pattern; a text that has it is cut in Python.
_END = "\uffff"


def cut(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, words, whole) of (doc_id, text): the text with an end mark after each piece, or as it is if it has such marks."""
    text = F.col("text")
    whole = F.contains(text, F.lit(_END))
    # (?U): white space as Unicode has it
    marked = F.regexp_replace(text, F.lit(f"(?U){pattern}"), F.lit(f"$0{_END}"))
    return docs.select("doc_id", F.when(whole, text).otherwise(marked).alias("words"), whole.alias("whole"))


def words(batch: pa.RecordBatch, pattern: str) -> Iterator[list[str]]:
    """The pieces of each text of a batch of ``cut``."""
    python = regex.compile(pattern)
    for text, whole in zip(batch.column("words"), batch.column("whole")):
        yield python.findall(text.as_py()) if whole.as_py() else text.as_py().split(_END)[:-1]
