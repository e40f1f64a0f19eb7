"""Hard negatives against brute force; trees and their pruning on their own."""

import random

import duckdb
import numpy as np
import pytest

from dirlens.llm import negatives, queries

SCHEMA = "vec_id long, label int, embedding array<float>, row string, comps int, cell int, block int, slot int, score int, rank int"


@pytest.fixture
def table(spark):
    def build(rows):
        return spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5, 6) for r in rows], SCHEMA)

    return build


def brute(rows, is_anchor, n_positive=5, n_negative=3, scale=256):
    dim = max((len(v) for _, _, v in rows if v is not None), default=0)
    kept = set()
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            kept.add((i, label, tuple(int(np.floor(scale * float(np.float32(x)))) for x in v) + (0,) * (dim - len(v))))
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2]))
    for a in kept:
        if is_anchor(a[0]):
            ps = sorted((-score(a, x), x[0], x) for x in kept if x != a and x[1] == a[1])[:n_positive]
            for neg, pid, _ in ps:
                s = -neg
                ns = sorted((-score(a, x), x[0], x) for x in kept if x[1] != a[1] and 50 * s <= 100 * score(a, x) <= 95 * s)[:n_negative]
                out += [(a[0], pid, r, x[1], s, -x[0]) for r, x in enumerate(ns, 1)]
    return sorted(out)


def vectors(n, dim, seed, clusters=5, labels=3):
    rng = random.Random(seed)
    centers = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(clusters)]
    return [(i, rng.randrange(labels), [c + rng.gauss(0, 0.2) for c in rng.choice(centers)]) for i in range(n)]


def odd_rows():
    nan, inf = float("nan"), float("inf")
    base = vectors(60, 3, 1)
    return [
        *base, *base[:7], (None, 1, [1.0, 0.0, 0.0]), (100, None, [1.0, 0.0, 0.0]), (101, 1, None), (102, 1, [1.0, None, 0.0]), (103, 1, [nan, 0.0, 0.0]),
        (104, 1, [inf, 0.0, 0.0]), (105, 1, []), (106, 2, [0.5]), (107, 2, [0.0, 0.0, 0.0]), (3, 0, [0.9, 0.1, 0.2]), (110, 1, [-1e4, 2e4, 3e4]),
        *[(200 + i, i % 3, [0.4, 0.4, 0.4]) for i in range(40)],
    ]


def check(got, rows, is_anchor, **options):
    assert sorted(map(tuple, got.collect())) == brute(rows, is_anchor, **options)


def test_equals_brute_force(table, monkeypatch):
    """Also with many cells, blocks, chunks, copies of blocks and deep trees."""
    rows = odd_rows()
    check(negatives.mined(table(rows), negatives.F.col("vec_id") % 5 == 0), rows, lambda i: i % 5 == 0)
    for name, value in (("BLOCK", 30), ("CHUNK", 4), ("MEETINGS", 2), ("LEAF", 4), ("SPLITS", 6), ("SAMPLE", 40)):
        monkeypatch.setattr(negatives, name, value)
    check(negatives.mined(table(rows), negatives.F.col("vec_id") % 5 == 0), rows, lambda i: i % 5 == 0)
    check(negatives.mined(table(rows), negatives.F.col("vec_id") % 9 == 0, positives=2, negatives=1), rows, lambda i: i % 9 == 0, n_positive=2, n_negative=1)


def test_tree_passes_siblings_over_and_loses_nothing():
    rng = np.random.default_rng(5)
    centers = rng.integers(-200, 200, (40, 16))
    x = centers[rng.integers(40, size=4000)] + rng.integers(-8, 9, (4000, 16))
    space = negatives._Space(float((x * x).sum(axis=1).max()))
    ids, labels = np.arange(4000), rng.integers(3, size=4000)
    tree = negatives.Tree(ids, ids, labels, x, space)
    assert sorted(tree.rows.tolist()) == list(range(4000))
    q = np.arange(0, 4000, 100)
    low = np.full((40, 1), -(1 << 62))
    search = negatives.Search({"rows": ids[q], "labels": labels[q], "comps": x[q], "low": low, "high": -low}, 5, True, space)
    seen = []
    leaf = negatives.Search._leaf
    search._leaf = lambda t, node, some: (seen.append((node.last - node.first) * len(some)), leaf(search, t, node, some))
    search.visit(tree, tree.root, np.arange(40))
    key, score, row, _ = search.held
    for a in range(40):
        products = x @ x[q[a]]
        others = [(-products[i], i) for i in range(4000) if labels[i] == labels[q[a]] and i != q[a]]
        assert [(-s, r) for k, s, r in zip(key, score, row) if k == a] == sorted(others)[:5]
    assert sum(seen) < 0.5 * 40 * 4000


def test_windows_are_whole_numbers(spark):
    scores = [-301, -1, 0, 1, 2, 3, 99, 101, 199, 65535, (1 << 62), -(1 << 62)]
    df = spark.createDataFrame([(s,) for s in scores], "s long")
    for share in (50, 95, 0, 100):
        got = df.select("s", negatives._percent(negatives.F.col("s"), share, True), negatives._percent(negatives.F.col("s"), share, False)).collect()
        assert [tuple(r) for r in got] == [(s, -(-s * share // 100), s * share // 100) for s in scores]


def test_empty_and_without_anchors(table):
    assert negatives.mined(table([]), negatives.F.col("vec_id") % 5 == 0).collect() == []
    assert negatives.mined(table([(1, 1, [1.0]), (2, 2, [1.0])]), negatives.F.col("vec_id") % 5 == 0).collect() == []
    assert negatives.mined(table([(5, 1, [1.0]), (2, 2, [1.0])]), negatives.F.col("vec_id") % 5 == 0).collect() == []


def test_registered_query_equals_its_sql(spark, tmp_path, table):
    rows = [(i, label, v) for i, label, v in vectors(400, 8, 3, labels=10)] + [(None, 1, [0.1] * 8), (900, None, [0.1] * 8), (950, 3, None)]
    table(rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["op12_hard_negatives"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    wanted = con.execute(queries.ORACLE["op12_hard_negatives"])
    assert [c[0] for c in wanted.description] == got.columns
    rows = wanted.fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(rows) and rows
