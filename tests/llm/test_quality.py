"""The line classifier: inference against enumeration, accuracy on held-out documents."""

import tracemalloc
from itertools import product

import numpy as np
import pyarrow as pa

from dirlens.llm import quality
from dirlens.llm.common import table
from dirlens.llm.quality import BINS, FEATURES, Model, accepted, fit, learn, line_features, marginals, score, scores


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    sizes = np.array([3, 0, 1, 5, 2])
    unary, pairs = rng.normal(size=sizes.sum()), rng.normal(size=(2, 2))
    good, expected, logz = marginals(unary, pairs, sizes)
    at, total, counts = 0, 0.0, np.zeros((2, 2))
    for size in sizes[sizes > 0]:
        weights = {}
        for labels in product((0, 1), repeat=int(size)):
            value = sum(unary[at + i] for i in range(size) if labels[i]) + sum(pairs[a, b] for a, b in zip(labels, labels[1:]))
            weights[labels] = np.exp(value)
        z = sum(weights.values())
        for i in range(size):
            assert np.isclose(good[at + i], sum(w for labels, w in weights.items() if labels[i]) / z)
        for labels, w in weights.items():
            for a, b in zip(labels, labels[1:]):
                counts[a, b] += w / z
        total += np.log(z)
        at += size
    assert np.allclose(expected, counts) and np.isclose(logz, total)


def test_score_weighs_lines_by_length():
    model = Model(np.zeros((len(FEATURES), BINS - 1)), np.zeros(3 * len(FEATURES) * (BINS + 1)), np.zeros((2, 2)))
    features, sizes, length = line_features(["ab cd.\n\nWord word word word", "", "  \n "], quality._kinds())
    assert sizes.tolist() == [2, 0, 0] and length.tolist() == [6, 19]
    assert features[1][FEATURES.index("distinct words")] == 0.5 and features[1][FEATURES.index("repeated words")] == 0.5
    assert scores(model, features, sizes, length).tolist() == [0.5, 0, 0]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = score(docs, learn(docs, labels)).join(labels, "doc_id").withColumn("held_out", quality.held_out()).toPandas()
    for held in (True, False):
        some = rows[rows["held_out"] == held]
        good, bad = some[some["quality"] == 1]["score"].to_numpy(), some[some["quality"] == 0]["score"].to_numpy()
        assert (good[:, None] > bad[None]).mean() > 0.97
        assert (good >= quality.THRESHOLD).mean() > 0.98


def test_odd_documents(spark, odd, none):
    labels = spark.createDataFrame([(6, 1), (7, 0), (7, 1), (None, 1), (8, None), (99, 1)], "doc_id long, quality int")
    for learnt in (learn(odd, labels), learn(none, labels), learn(odd, labels.limit(0))):
        found = score(odd, learnt).collect()
        assert len(found) == odd.count() and all(0 <= r.score <= 1 for r in found)
        assert all(r.score == 0 for r in found if r.doc_id in (1, 2, 3))
        kept = accepted(odd, learnt, 0.0)
        assert kept.columns == odd.columns and kept.count() == odd.count()
        assert score(none, learnt).collect() == accepted(none, learnt).collect() == []
    assert learn(odd, labels.limit(0)).constant == 0.5


def test_one_kind_of_labels():
    assert fit(np.zeros((3, len(FEATURES))), np.array([2, 1]), np.array([1, 1])).constant == 1.0


def test_only_the_sample_comes_to_the_driver(spark, docs, monkeypatch):
    """Documents are taken by their numbers of lines; many texts under one id are bounded as well."""
    from dirlens.llm import quality

    rows = [(i % 4, "\n".join(f"line {j} of {i}, as good as any." for j in range(i % 6 + 1))) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    sizes = []
    plain = quality.fit
    monkeypatch.setattr(quality, "fit", lambda features, lines, marks: sizes.append(lines.tolist()) or plain(features, lines, marks))
    for most in (10, 10_000):
        monkeypatch.setattr(quality, "SAMPLE_LINES", most)
        model = quality.learn(docs(*rows), labels)
        assert sum(sizes[-1]) <= most and len(sizes[-1]) > 1
        assert quality.score(docs(*rows), model).count() == 60


def test_few_texts_are_strings_at_a_time():
    """A batch of many short texts isn't unpacked as a whole."""
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(2_300)), "text": [f"line {i}" for i in range(2_300)]})
    blocks = list(quality._blocks(iter([batch])))
    assert max(len(block) for _, block in blocks) <= 500
    assert [t for _, block in blocks for t in block] == batch.column("text").to_pylist()
    assert [d for part, _ in blocks for d in part.column("doc_id").to_pylist()] == list(range(2_300))


def test_training_memory_is_bounded_by_a_byte_a_bin():
    """The driver holds a byte for each bin of a line and its neighbours; weights are looked up a few lines at a time."""
    rng = np.random.default_rng(4)
    sizes, labels = rng.integers(0, 40, 2_000), rng.integers(0, 2, 2_000)
    features = rng.normal(size=(sizes.sum(), len(FEATURES))) + np.repeat(labels, sizes)[:, None]
    tracemalloc.start()
    fit(features, sizes, labels, steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * features.nbytes
