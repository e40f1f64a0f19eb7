"""Exact top-k against plain Python."""

import random
from math import floor, isfinite

import pytest
from pyspark.sql import functions as F

from dirlens.llm import topk
from dirlens.llm.topk import exact_topk


def plain(rows, is_query, k):
    """Best other rows of each query row; rows of equal length only."""
    good = {(i, tuple(floor(1024 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and isfinite(x) for x in v)}
    out = set()
    for q, qv in good:
        if is_query(q):
            found = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in good if i != q and len(v) == len(qv))
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(found[:k], 1)}
    return out


def search(spark, rows, every, k, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cls", F.lit("clash")).withColumn("score", F.lit(1))
    return {tuple(r) for r in exact_topk(df, F.col("vec_id") % every == 0, k=k, **options).collect()}


@pytest.mark.parametrize("slices", [1, 2, 3])
def test_equals_plain_search(spark, slices):
    rng = random.Random(slices)
    rows = [(i, [rng.choice((rng.gauss(0, 1), 0.5, -0.25)) for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, rows[10][1]) for i in range(40)]  # a large group of copies, ties
    rows += [rows[0], rows[20]]  # repeated rows
    assert search(spark, rows, 10, 4, slices=slices) == plain(rows, lambda i: i % 10 == 0, 4)


def test_odd_vectors(spark):
    rows = [
        (None, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (10, []), (0, [1.0, 1.0]), (6, [2.0, 1.0]),
        (20, [1.0, 2.0, 3.0]), (7, [-1.0, -1.0]), (8, [1e12, -1e12]),
    ]
    found = search(spark, rows, 10, 3)
    assert found == plain(rows, lambda i: i % 10 == 0, 3)
    assert {q for q, *_ in found} == {0, 10}


def test_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK_BYTES", 3 * 64)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    assert search(spark, rows, 7, 3) == plain(rows, lambda i: i % 7 == 0, 3)


def test_no_rows(spark):
    assert search(spark, [], 10, 3) == set()
    assert search(spark, [(1, [1.0])], 10, 3) == set()
