"""Hard negatives for contrastive training, by a multiway hyperplane tree over all vectors.

An anchor's positives are the vectors of its label with the highest inner products; the hard negatives of a positive are the
vectors of other labels whose inner product lies in a window below the positive's. Both are searches for the first few rows of
a window of scores. With a further component sqrt(M^2 - |x|^2) for each vector, and 0 for the anchor, where M is the greatest norm,

    |q - x|^2 = |q|^2 + M^2 - 2 <q, x>

so that a window of scores is an annulus around the anchor. A node of the tree has split points; each row belongs to the nearest
one, and each split point keeps the smallest and greatest distance to the rows of each of its siblings. By the triangle inequality
a sibling is passed over if no distance in its range, from any split point, meets the annulus, or the part of it
that could still be among the first few. Leaves are compared in whole numbers; distances only say what to leave out, with a slack
for rounding.

The top node is Spark's: at most ``SPLITS`` points from a sample of ``SAMPLE`` rows cut all rows into cells, each cell into blocks of
about ``BLOCK`` rows by a hash, and a block's tree is one row of a table. Anchors come in chunks of about ``CHUNK``, by cell. A chunk goes to
the blocks of the cells that its annuli meet, and a task holds one block and one chunk at a time. Positives are first looked for in
the anchor's own cell, which bounds the search in the others.

What is broadcast has a fixed bound: the split points, and the ranges between cells.

Defined results: rows with a null id, label or vector, or a null, NaN or infinite component, take no part; repeated rows count once; rows that
share an id only are rows of their own; a shorter vector counts as having zeros at its end; ties go to the smaller id;
other columns are not looked at; without rows or anchors there are no results.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dirlens.llm.common import written
from dirlens.llm.topk import _products

SPLITS = 32
SAMPLE = 1024
BLOCK = 8192
CHUNK = 512
#: Chunks that meet one copy of a block.
MEETINGS = 64
#: Split points of a node within a block, and rows of a leaf.
DEGREE = 8
LEAF = 256

_FOUND = "anchor long, slot int, score long, row long, vec_id long"


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them."""
    for kind in ("i1", "i2", "i4"):
        if not x.size or (np.iinfo(kind).min <= x.min() and x.max() <= np.iinfo(kind).max):
            return x.astype(kind)
    return x


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows, with zeros at the end of shorter ones."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype("i8")
    out, flat = np.zeros((len(sizes), dim), "i8"), lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class _Space:
    """Vectors with the further component that gives all of them the norm M."""

    def __init__(self, top: float):
        self.top = top  # M^2

    def rest(self, x: np.ndarray) -> np.ndarray:
        x = x.astype("f8")
        return np.sqrt(np.maximum(0, self.top - np.einsum("ij,ij->i", x, x)))

    def among_rows(self, x: np.ndarray, x_rest: np.ndarray, y: np.ndarray, y_rest: np.ndarray) -> np.ndarray:
        """Distances of rows to rows."""
        return np.sqrt(np.maximum(0, 2 * (self.top - x.astype("f8") @ y.astype("f8").T - np.outer(x_rest, y_rest))))

    def from_anchors(self, size: np.ndarray, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Distances of anchors, with their squared norms, to rows."""
        return np.sqrt(np.maximum(0, size[:, None] + self.top - 2 * (q.astype("f8") @ x.astype("f8").T)))


def spread(x: np.ndarray, rest: np.ndarray, space: _Space, n: int) -> np.ndarray:
    """Numbers of up to n rows that lie far from each other: always the one farthest from those that were taken."""
    taken = [0]
    away = space.among_rows(x, rest, x[:1], rest[:1])[:, 0]
    while len(taken) < n and away.max() > 0:
        taken.append(int(away.argmax()))
        away = np.minimum(away, space.among_rows(x, rest, x[taken[-1:]], rest[taken[-1:]])[:, 0])
    return np.array(taken)


@dataclass
class Node:
    """Rows first..last: a leaf, or split points with a child each and the ranges of distances to the children's rows."""

    first: int
    last: int
    points: np.ndarray | None = None
    children: list[Node] | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None


class Tree:
    """A block's rows, in the order of the leaves."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, comps: np.ndarray, space: _Space):
        order: list[np.ndarray] = []
        rest = space.rest(comps)
        self.root = self._node(np.arange(len(rows)), comps, rest, space, order, 0)
        at = np.concatenate(order)
        self.rows, self.ids, self.labels, self.comps = rows[at], ids[at], labels[at], _narrow(comps[at])

    def dumped(self) -> bytes:
        """Arrays and tuples only."""

        def plain(x: Node) -> tuple:
            return x.first, x.last, x.points, x.children and [plain(c) for c in x.children], x.low, x.high

        return pickle.dumps((self.rows, self.ids, self.labels, self.comps, plain(self.root)), 5)

    @classmethod
    def loaded(cls, data) -> Tree:
        def node(x: tuple) -> Node:
            return Node(*x[:3], x[3] and [node(c) for c in x[3]], *x[4:])

        tree = cls.__new__(cls)
        *arrays, root = pickle.loads(data)
        tree.rows, tree.ids, tree.labels, tree.comps = arrays
        tree.root = node(root)
        return tree

    def _node(self, at: np.ndarray, comps: np.ndarray, rest: np.ndarray, space: _Space, order: list, first: int) -> Node:
        if len(at) > LEAF:
            some = at[np.linspace(0, len(at) - 1, min(len(at), 6 * DEGREE)).astype("i8")]
            points = some[spread(comps[some], rest[some], space, DEGREE)]
            away = space.among_rows(comps[points], rest[points], comps[at], rest[at])
            nearest = away.argmin(axis=0)
            sizes = np.bincount(nearest, minlength=len(points))
            if sizes.max() < 0.95 * len(at):
                children, low, high, start = [], [], [], first
                for j in range(len(points)):
                    mine = nearest == j
                    children.append(self._node(at[mine], comps, rest, space, order, start))
                    low.append(away[:, mine].min(axis=1) if mine.any() else np.full(len(points), np.inf))
                    high.append(away[:, mine].max(axis=1) if mine.any() else np.full(len(points), -np.inf))
                    start += int(sizes[j])
                return Node(first, first + len(at), comps[points], children, np.array(low).T, np.array(high).T)
        order.append(at)
        return Node(first, first + len(at))


class Search:
    """The first ``keep`` rows in each window of each anchor of a chunk. Windows are slots of an anchor, with a lowest and a highest score."""

    def __init__(self, chunk: dict, keep: int, same: bool, space: _Space):
        self.rows, self.labels, self.comps = chunk["rows"], chunk["labels"], chunk["comps"]
        self.low, self.high = chunk["low"], chunk["high"]  # anchors x slots; a window with low > high is none
        self.keep, self.same, self.space = keep, same, space
        self.size = np.einsum("ij,ij->i", self.comps.astype("f8"), self.comps.astype("f8"))
        self.slack = 1 + 1e-6 * (self.size + space.top)
        self.least = self.low.copy()  # scores from here on can still be among the first
        none = np.empty(0, "i8")
        self.held = (none, none, none, none)  # anchor * slots + slot, score, row, id

    def reach(self, points: np.ndarray, low: np.ndarray, high: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The highest and lowest score that the anchors can have with the rows of each sibling."""
        away = self.space.from_anchors(self.size[some], self.comps[some], points)[:, :, None]
        nearest = np.maximum(0, np.maximum(away - high, low - away).max(axis=1))
        farthest = (away + high).min(axis=1)
        total, slack = (self.size[some] + self.space.top)[:, None], self.slack[some][:, None]
        with np.errstate(invalid="ignore"):
            return (total - nearest * nearest) / 2 + slack, (total - np.maximum(farthest, 0) ** 2) / 2 - slack

    def meets(self, some: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Of some anchors, those with a window that scores from least to most meet."""
        return ((most[:, None] >= self.least[some]) & (least[:, None] <= self.high[some]) & (self.least[some] <= self.high[some])).any(axis=1)

    def cells(self, points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Cells that some anchor's annuli meet."""
        every = np.arange(len(self.rows))
        most, least = self.reach(points, low, high, every)
        return np.array([self.meets(every, most[:, j], least[:, j]).any() for j in range(low.shape[1])], bool)

    def visit(self, tree: Tree, node: Node, some: np.ndarray) -> None:
        if node.last == node.first or not len(some):
            return
        if node.children is None:
            self._leaf(tree, node, some)
            return
        most, least = self.reach(node.points, node.low, node.high, some)
        for j in np.argsort(-most.max(axis=0)):
            left = self.meets(some, most[:, j], least[:, j])  # again for each: what is found narrows the annuli
            self.visit(tree, node.children[j], some[left])

    def _leaf(self, tree: Tree, node: Node, some: np.ndarray) -> None:
        rows, labels = tree.rows[node.first : node.last], tree.labels[node.first : node.last]
        scores = _products(self.comps[some].astype("i8"), tree.comps[node.first : node.last].astype("i8"))
        right = (labels == self.labels[some][:, None]) == self.same
        right &= rows != self.rows[some][:, None]
        right &= (scores >= self.least[some].min(axis=1)[:, None]) & (scores <= self.high[some].max(axis=1)[:, None])
        a, x = np.nonzero(right)
        score = scores[a, x]
        a = some[a]
        pair, slot = np.nonzero((score[:, None] >= self.least[a]) & (score[:, None] <= self.high[a]))
        if not len(pair):
            return
        found = (a[pair] * self.low.shape[1] + slot, score[pair], rows[x[pair]], tree.ids[node.first : node.last][x[pair]])
        key, score, row, ids = (np.concatenate(c) for c in zip(self.held, found))
        order = np.lexsort((row, ids, -score, key))
        key, score, row, ids = key[order], score[order], row[order], ids[order]
        rank = np.arange(len(key)) - np.searchsorted(key, key)
        kept = rank < self.keep
        self.held = (key[kept], score[kept], row[kept], ids[kept])
        full = rank == self.keep - 1
        flat = self.least.reshape(-1)
        flat[key[full]] = np.maximum(flat[key[full]], score[full])  # an equal score with a smaller id still counts

    def batch(self) -> pa.RecordBatch:
        key, score, row, ids = self.held
        slots = self.low.shape[1]
        return pa.RecordBatch.from_arrays(
            [pa.array(self.rows[key // slots]), pa.array((key % slots).astype("i4")), pa.array(score), pa.array(row), pa.array(ids)],
            ["anchor", "slot", "score", "row", "vec_id"],
        )


def prepared(vectors: DataFrame, id_col: str, label_col: str | Column, vector_col: str, scale: float) -> DataFrame:
    """(row, vec_id, label, comps) of the rows that take part, each once, written; ``comps`` are floor(scale * component)."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    rows = vectors.filter(F.col(id_col).isNotNull() & label.isNotNull() & F.col(vector_col).isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"),
        F.transform(vector_col, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("comps"),
    )
    return written(rows.dropDuplicates().withColumn("row", F.monotonically_increasing_id()), "negatives-rows")


class Index:
    """All rows as trees: the split points on the driver, a table of blocks, and the ranges between cells."""

    def __init__(self, rows: DataFrame):
        self.spark = rows.sparkSession
        norm = F.aggregate("comps", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
        total = rows.agg(F.max(norm).alias("top"), F.max(F.size("comps")).alias("dim"), F.count("*").alias("n")).first()
        self.n, self.dim, self.space = total["n"], total["dim"] or 0, _Space(total["top"] or 0.0)
        if not self.n:
            return
        sample = rows.select("comps", F.xxhash64("vec_id", "label", "comps").alias("h")).orderBy("h").limit(SAMPLE).select("comps").toArrow()
        sample = _matrix(sample.column("comps").combine_chunks(), self.dim)
        rest = self.space.rest(sample)
        taken = spread(sample, rest, self.space, SPLITS)
        self.points, self.points_rest = sample[taken], rest[taken]
        self.celled = written(self._assigned(rows), "negatives-cells")
        counts = {r["cell"]: r["n"] for r in self.celled.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        sizes = F.array(*(F.lit(-(-counts.get(c, 1) // BLOCK)) for c in range(len(self.points))))
        block = F.pmod(F.xxhash64("vec_id", "label", "row"), F.get(sizes, F.col("cell"))) * SPLITS + F.col("cell")
        self.blocks = written(self._built(self.celled.withColumn("block", block)), "negatives-blocks")
        each = self.blocks.select("cell", F.posexplode(F.arrays_zip("low", "high")).alias("i", "r"))
        ranges = each.groupBy("cell", "i").agg(F.min("r.low").alias("low"), F.max("r.high").alias("high")).collect()
        k = len(self.points)
        self.low, self.high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
        for r in ranges:
            self.low[r["i"], r["cell"]], self.high[r["i"], r["cell"]] = r["low"], r["high"]

    def _assigned(self, rows: DataFrame) -> DataFrame:
        points, points_rest, space, dim = self.points, self.points_rest, self.space, self.dim

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column("comps"), dim)
                cell = space.among_rows(x, space.rest(x), points, points_rest).argmin(axis=1).astype("i4")
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

        return rows.mapInArrow(assign, "vec_id long, label long, comps array<long>, row long, cell int")

    def _built(self, rows: DataFrame) -> DataFrame:
        points, points_rest, space, dim = self.points, self.points_rest, self.space, self.dim

        def build(group: pa.Table) -> pa.Table:
            group = group.combine_chunks()
            comps = _matrix(group.column("comps").chunk(0), dim)
            away = space.among_rows(points, points_rest, comps, space.rest(comps))
            tree = Tree(*(group.column(c).to_numpy() for c in ("row", "vec_id", "label")), comps, space)
            return pa.table({
                "block": group.column("block")[:1], "cell": group.column("cell")[:1], "low": [away.min(axis=1).tolist()],
                "high": [away.max(axis=1).tolist()], "tree": [tree.dumped()],
            })

        return rows.groupBy("block").applyInArrow(build, "block long, cell int, low array<double>, high array<double>, tree binary")

    def _chunks(self, anchors: DataFrame) -> DataFrame:
        """(chunk, cell, data) of anchors (row, label, comps, cell, low, high)."""
        dim = self.dim
        counts = {r["cell"]: r["n"] for r in anchors.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        sizes = F.array(*(F.lit(-(-counts.get(c, 1) // CHUNK)) for c in range(len(self.points))))
        chunk = F.pmod(F.xxhash64("row"), F.get(sizes, F.col("cell"))) * SPLITS + F.col("cell")

        def pack(group: pa.Table) -> pa.Table:
            group = group.combine_chunks()
            low, high = (np.array(group.column(c).to_pylist(), "i8").reshape(group.num_rows, -1) for c in ("low", "high"))
            data = {
                "rows": group.column("row").to_numpy(), "labels": group.column("label").to_numpy(),
                "comps": _narrow(_matrix(group.column("comps").chunk(0), dim)), "low": low, "high": high,
            }
            return pa.table({"chunk": group.column("chunk")[:1], "cell": group.column("cell")[:1], "data": [pickle.dumps(data, 5)]})

        packed = anchors.select("row", "label", "comps", "cell", "low", "high", chunk.alias("chunk"))
        return written(packed.groupBy("chunk").applyInArrow(pack, "chunk long, cell int, data binary"), "negatives-chunks")

    def search(self, anchors: DataFrame, keep: int, same: bool, where: str = "all") -> DataFrame:
        """(anchor, slot, score, row, vec_id): the first ``keep`` rows in each window, of the cells asked for: all, home or others."""
        points, low, high, space = self.points, self.low, self.high, self.space
        chunks = self._chunks(anchors)
        n_chunks = chunks.count()
        parts = max(1, -(-n_chunks // MEETINGS))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk, home, data in zip(*(batch.column(c).to_pylist() for c in ("chunk", "cell", "data"))):
                    cells = np.flatnonzero(Search(pickle.loads(data), keep, same, space).cells(points, low, high)) if where != "home" else np.array([home])
                    if where == "others":
                        cells = cells[cells != home]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), chunk)), pa.array(cells.astype("i4"))], ["chunk", "to"])

        routes = chunks.mapInArrow(route, "chunk long, to int").join(self.blocks.select("block", F.col("cell").alias("to")), "to")
        part = F.pmod(F.xxhash64("chunk"), F.lit(parts)).cast("int")
        asking = routes.join(chunks.select("chunk", "data"), "chunk").select("block", part.alias("part"), F.lit(1).alias("kind"), "data")
        copies = self.blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), F.col("tree").alias("data"))

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = None
            for batch in batches:
                for kind, data in zip(batch.column("kind"), batch.column("data")):
                    if kind.as_py() == 0:
                        tree = Tree.loaded(data.as_buffer())
                    else:
                        chunk = Search(pickle.loads(data.as_buffer()), keep, same, space)
                        chunk.visit(tree, tree.root, np.arange(len(chunk.rows)))
                        yield chunk.batch()

        both = copies.unionByName(asking).repartition("block", "part").sortWithinPartitions("block", "part", "kind")
        return both.mapInArrow(meet, _FOUND)


def _first(found: DataFrame, keep: int) -> DataFrame:
    """The first ``keep`` of each anchor's slot, with their rank from 1."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def _percent(score: Column, share: int, up: bool) -> Column:
    """A percentage of a score, rounded up or down, in whole numbers: hundreds first, as a product could overflow."""
    rest = score % 100
    return F.call_function("div", score - rest, F.lit(100).cast("long")) * share + (F.ceil if up else F.floor)(rest * share / 100)


def mined(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0,
          id_col: str = "vec_id", label_col: str | Column = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on ``vec_id``. A negative's score is at least ``low`` and at most ``high`` percent of the positive's.
    """
    rows = prepared(vectors, id_col, label_col, vector_col, scale)
    spark = rows.sparkSession
    index = Index(rows)
    if not index.n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    anchors = index.celled.filter(is_anchor)
    least, most = -(1 << 62), 1 << 62

    def window(lowest: Column, highest: Column) -> list[Column]:
        return [F.array(lowest.cast("long")).alias("low"), F.array(highest.cast("long")).alias("high")]

    asked = anchors.select("*", *window(F.lit(least), F.lit(most)))
    home = written(_first(index.search(asked, positives, True, "home"), positives), "negatives-home")
    # what was found at home bounds the search elsewhere
    bound = home.filter(F.col("rank") == positives).select(F.col("anchor").alias("row"), F.col("score").alias("bound"))
    asked = anchors.join(bound, "row", "left").select(anchors["*"], *window(F.coalesce("bound", F.lit(least)), F.lit(most)))
    away = index.search(asked, positives, True, "others")
    best = written(_first(home.drop("rank").unionByName(away), positives), "negatives-positives")
    score = F.col("score")
    slot = F.struct((F.col("rank") - 1).alias("slot"), _percent(score, low, True).alias("low"), _percent(score, high, False).alias("high"))
    windows = best.groupBy(F.col("anchor").alias("row")).agg(F.sort_array(F.collect_list(slot)).alias("w"))
    # every anchor has as many slots; those without a positive have no window
    pad = lambda part, none: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get("w", i)[part], F.lit(none).cast("long")))
    asked = anchors.join(windows, "row").select(anchors["*"], pad("low", most).alias("low"), pad("high", least).alias("high"))
    found = _first(index.search(asked, negatives, False), negatives)
    of_positive = best.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), score.alias("positive_score"))
    return (
        found.join(of_positive, ["anchor", "slot"]).join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
        .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )
