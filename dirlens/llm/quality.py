"""Document quality from a linear-chain conditional random field over lines.

Every non-blank line is labelled good or bad. Its evidence are its own features and those of the lines
before and after it, each feature binned; neighbouring labels depend on each other. The score of a document
is the mean of its lines' forward-backward marginals of "good", weighted by line length.

Labels exist for documents only: in training, every line has its document's label. The model is fitted on
the driver to at most ``SAMPLE_DOCS`` labelled documents, the ones with the smallest hash of their id, and
at most ``SAMPLE_LINES`` lines of them; it has a few hundred weights. Scoring reads every line of every text.

Defined results: a null, empty or blank text has the score 0; a null id stays null and is never learnt from;
repeated rows are scored each; conflicting labels of an id count as the lower one; with no labels, or with
labels of one kind only, every text with a non-blank line has the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirlens.llm.common import texts, written

SAMPLE_DOCS = 6000
SAMPLE_LINES = 200_000
#: From this score on a document counts as good.
THRESHOLD = 0.3
BINS = 10
STEPS = 250
#: Documents are read in blocks of about as many characters.
BLOCK_CHARS = 2 << 20
#: Texts of a batch that are Python strings at a time.
_SLICE = 500
#: Lines whose weights are looked up at a time.
_LINES = 1 << 13
FEATURES = (
    "log length", "log words", "letters", "capitals", "digits", "symbols", "spaces", "letters a word", "symbols a word",
    "distinct words", "repeated words", "repeats a line", "ends a sentence", "starts with a capital",
)
LOWER, UPPER, DIGIT, SPACE, SYMBOL = range(5)


def _kinds() -> np.ndarray:
    """The kind of each code point of the basic plane; others count as lower-case letters."""
    kind = np.full(0x110000, LOWER, "u1")
    for c in range(0x10000):
        s = chr(c)
        kind[c] = UPPER if s.isupper() else DIGIT if s.isdigit() else SPACE if s.isspace() else LOWER if s.isalpha() else SYMBOL
    return kind


def line_features(block: list[str], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all non-blank lines of some texts, the number of lines of each text, and line lengths."""
    lines, words, distinct, again, repeats, sizes = [], [], [], [], [], []
    for text in block:
        seen: set[str] = set()
        before = len(lines)
        for line in text.split("\n"):
            if split := line.split():
                lines.append(line)
                words.append(len(split))
                distinct.append(len(set(split)))
                again.append(sum(map(eq, split, split[1:])))
                repeats.append(line in seen)
                seen.add(line)
        sizes.append(len(lines) - before)
    sizes = np.array(sizes, "i8")
    if not lines:
        return np.zeros((0, len(FEATURES))), sizes, np.zeros(0)
    length = np.array([len(x) for x in lines], "f8")
    kind = kinds[np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "u4")]
    starts = np.cumsum(np.concatenate([[0], length[:-1]])).astype("i8")
    lower, upper, digit, space, symbol = (np.add.reduceat(kind == k, starts, dtype="i8") for k in range(5))
    words = np.array(words, "f8")
    letters = lower + upper
    ends = np.array([x.rstrip()[-1] in ".!?" for x in lines])
    capital = np.array([x.lstrip()[0].isupper() for x in lines])
    return np.column_stack([
        np.log1p(length), np.log1p(words), letters / length, upper / np.maximum(letters, 1), digit / length, symbol / length,
        space / length, letters / words, symbol / words, np.array(distinct) / words, np.array(again) / words, repeats, ends, capital,
    ]).astype("f8"), sizes, length


@dataclass
class Model:
    """Bin edges per feature; weights [own | before | after][feature][bin]; scores of label pairs.

    The last bin stands for "no such line". Weights speak for label 1 against label 0.
    """

    edges: np.ndarray
    weights: np.ndarray
    pairs: np.ndarray
    constant: float | None = None

    def bins(self, features: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x, "right").astype("u1") for e, x in zip(self.edges, features.T)])


def _placed(bins: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """The bins of every line and those of its neighbours within the text, a byte each."""
    n = len(bins)
    ends = np.cumsum(sizes[sizes > 0])
    before, after = np.full_like(bins, width - 1), np.full_like(bins, width - 1)
    if n:
        before[1:], after[:-1] = bins[:-1], bins[1:]
        before[np.concatenate([[0], ends[:-1]])] = width - 1
        after[ends - 1] = width - 1
    return np.hstack([bins, before, after])


def _unary(weights: np.ndarray, placed: np.ndarray, width: int) -> np.ndarray:
    """The sum of every line's weights, a bounded number of lines at a time."""
    base = np.arange(placed.shape[1]) * width
    return np.concatenate([np.zeros(0), *(weights[placed[i : i + _LINES] + base].sum(1) for i in range(0, len(placed), _LINES))])


def marginals(unary: np.ndarray, pairs: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(label 1) of each line, the expected number of each pair of labels, and the log of all texts' normalisers.

    Texts are run side by side, longest first, so that step t works on the texts that have a line t.
    """
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    first = (np.cumsum(sizes) - sizes)[order]
    size = sizes[order]
    depth = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(depth), "left") if depth else np.zeros(0, "i8")
    odds = np.clip(unary, -30, 30)
    shift = np.maximum(odds, 0)
    local = np.exp(np.column_stack([-shift, odds - shift]))
    trans = np.exp(pairs)
    ahead, scale = np.empty_like(local), np.ones(len(odds))
    for t in range(depth):
        at = first[: active[t]] + t
        a = local[at] if t == 0 else (ahead[at - 1] @ trans) * local[at]
        scale[at] = a.sum(1)
        ahead[at] = a / scale[at][:, None]
    back = np.ones_like(local)
    expected = np.zeros((2, 2))
    for t in range(depth - 1, 0, -1):
        at = first[: active[t]] + t
        message = local[at] * back[at] / scale[at][:, None]
        back[at - 1] = message @ trans.T
        expected += ahead[at - 1].T @ message * trans
    both = ahead * back
    return both[:, 1] / both.sum(1), expected, float(np.log(scale).sum() + shift.sum())


def fit(features: np.ndarray, sizes: np.ndarray, labels: np.ndarray, steps: int = STEPS, decay: float = 2e-3) -> Model:
    """The maximum of the conditional likelihood, less a penalty on large weights, by full gradients; ``labels`` has one per text."""
    edges = np.quantile(features, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if len(features) else np.zeros((len(FEATURES), BINS - 1))
    width = BINS + 1
    model = Model(edges, np.zeros(3 * len(FEATURES) * width), np.zeros((2, 2)))
    if not len(features) or labels[sizes > 0].min() == labels[sizes > 0].max():
        known = labels[sizes > 0]
        model.constant = float(known.mean()) if len(known) else 0.5
        return model
    at = _placed(model.bins(features), sizes, width)
    columns, truth = np.ascontiguousarray(at.T), np.repeat(labels, sizes).astype("f8")
    inner = np.repeat(labels, np.maximum(sizes - 1, 0) * (sizes > 0))
    seen = np.diag([float((inner == 0).sum()), float((inner == 1).sum())])
    theta = np.zeros(len(model.weights) + 4)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        model.weights, model.pairs = theta[:-4], theta[-4:].reshape(2, 2)
        good, expected, _ = marginals(_unary(model.weights, at, width), model.pairs, sizes)
        wrong = good - truth
        grad = np.concatenate([*(np.bincount(column, wrong, width) for column in columns), (expected - seen).ravel()]) / len(features) + decay * np.concatenate([theta[:-4], np.zeros(4)])
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
        theta = theta - 0.1 * (1 - step / (steps + 1)) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    model.weights, model.pairs = theta[:-4].copy(), theta[-4:].reshape(2, 2).copy()
    return model


def scores(model: Model, features: np.ndarray, sizes: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The score of each text."""
    if model.constant is not None:
        return np.where(sizes > 0, model.constant, 0.0)
    unary = _unary(model.weights, _placed(model.bins(features), sizes, BINS + 1), BINS + 1) if len(features) else np.zeros(0)
    good = marginals(unary, model.pairs, sizes)[0]
    text = np.repeat(np.arange(len(sizes)), sizes)
    total = np.bincount(text, length, len(sizes))
    return np.clip(np.bincount(text, good * length, len(sizes)) / np.maximum(total, 1), 0, 1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(first, _SLICE) for first in range(0, batch.num_rows, _SLICE))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in _slices(batches):
        block = batch.column("text").to_pylist()
        first = size = 0
        for i, text in enumerate(block):
            size += len(text)
            if size >= BLOCK_CHARS or i + 1 == len(block):
                yield batch.slice(first, i + 1 - first), block[first : i + 1]
                first, size = i + 1, 0


def held_out(id_col: str = "doc_id") -> Column:
    """The fifth of all ids that is never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model from labelled documents outside the held-out fifth."""
    known = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.min("label").alias("label"))
        .filter(~held_out()).withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(SAMPLE_DOCS)
    )
    chosen = texts(docs, id_col, text_col).join(F.broadcast(known), "doc_id")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _kinds()
        for batch, block in _blocks(batches):
            features, sizes, _ = line_features(block, kinds)
            cuts = np.cumsum(sizes)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "label": batch.column("label"), "place": batch.column("place"), "lines": sizes,
                "features": [features[b - n : b].astype("f4").tobytes() for n, b in zip(sizes, cuts)],
            })

    rows = chosen.mapInArrow(measured, "doc_id long, label int, place long, lines long, features binary").dropDuplicates()
    rows = written(rows.withColumn("h", F.xxhash64("features")), "quality-rows")
    # which rows fit is decided by their numbers of lines; only the features of these come to the driver
    total, chosen_rows = 0, []
    for row in rows.filter("lines > 0").select("place", "doc_id", "h", "lines").orderBy("place", "doc_id", "h").limit(SAMPLE_LINES).collect():
        if total + row["lines"] <= SAMPLE_LINES:
            chosen_rows.append((row["place"], row["doc_id"], row["h"]))
            total += row["lines"]
    names = docs.sparkSession.createDataFrame(chosen_rows, "place long, doc_id long, h long")
    kept = sorted(rows.join(F.broadcast(names), ["place", "doc_id", "h"], "left_semi").collect(), key=lambda r: (r["place"], r["doc_id"], r["h"]))
    features = np.frombuffer(b"".join(r["features"] for r in kept), "f4").reshape(-1, len(FEATURES)).astype("f8")
    return fit(features, np.array([r["lines"] for r in kept], "i8"), np.array([r["label"] for r in kept], "i8"))


def _scores(model: Model, batch: pa.RecordBatch, text_col: str, kinds: np.ndarray) -> np.ndarray:
    text = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(text_col)).cast(pa.string()).fill_null("")], ["text"])
    return np.concatenate([np.zeros(0), *(scores(model, *line_features(block, kinds)) for _, block in _blocks(iter([text])))])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every document."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _kinds()
        for batch in _slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(model, batch, "text", kinds))], ["doc_id", "score"])

    return texts(docs, id_col, text_col).mapInArrow(scored, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents with at least the threshold's score, with all their columns."""

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _kinds()
        for batch in _slices(batches):
            yield batch.filter(pa.array(_scores(model, batch, text_col, kinds) >= threshold))

    return docs.mapInArrow(filtered, docs.schema)
