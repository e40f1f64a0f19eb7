"""A corpus pipeline: documents that are good, without repeated lines, one of each near copy, clear of benchmarks, as token ids.

Every stage takes all documents that its predecessor kept, as a Parquet table, and returns a DataFrame; all stages but the
last keep the columns of ``documents``.
"""

from __future__ import annotations

from hashlib import sha256

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dirlens.llm import bytebpe, decontaminate, linededup, quality, simhash
from dirlens.llm.common import table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.accepted(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that match an earlier one; ``n_chars`` follows the text."""
    kept = linededup.deduplicated(docs)
    kind = dict(docs.dtypes).get("n_chars")
    return kept if kind is None else kept.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by SimHash."""
    return simhash.one_of_each(docs, length=4, most=4)


def no_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return decontaminate.without_matches(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): byte-level BPE ids of every text, and a digest of the bytes that they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decode = bytebpe.decoder(path)

    def row(doc_id, ids) -> dict:
        return {"doc_id": doc_id, "n_tokens": len(ids), "ids": ids, "decoded_sha256": sha256(decode(ids)).hexdigest()}

    return bytebpe.documents(docs, path, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string", row)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", distinct_lines),
    ("simhash near-dedup", one_of_each),
    ("benchmark decontamination", no_benchmarks),
    ("byte-level bpe", token_ids),
]

#: Models, edit distances and merges aren't SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``; what the others kept is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = written(docs, f"pipeline-{number}")
    return docs
