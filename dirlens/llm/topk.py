"""Exact top-k inner products by the three-phase uniform threshold.

The components are cut into slices; every task holds lists of partial scores, one per query and slice.

1. Each task gives its best partial scores per slice, with the whole scores of these vectors. The k-th best
   of the whole scores is a safe cutoff.
2. The cutoff is broadcast. A vector that reaches it must reach its share of it in some slice, so
   tasks send exactly these entries; lower and upper bounds of what arrived give a sharper cutoff.
3. Only vectors whose upper bound reaches that cutoff have their missing partial scores looked up.

Vectors that are alike are searched once, as a class that carries its k + 1 smallest ids. Queries come
in chunks of at most ``CHUNK_BYTES``, each broadcast in turn; a chunk is the only data that meets all rows.

Defined results: a null id, a null vector or one with a null, NaN or infinite component takes no part;
repeated rows count once; only vectors of equal length are compared; ties go to the smaller id;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dirlens.llm.common import written
from dirlens.session import work_folder

CHUNK_BYTES = 4 << 20
SCORES_PER_STEP = 1 << 21


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(vec_id, comps): floor(scale * component) as long, for the vectors that take part, each once."""
    finite = F.forall(
        vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    )
    return (
        df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
        .select(
            F.col(id_col).cast("long").alias("vec_id"),
            F.transform(vector_col, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("comps"),
        )
        .dropDuplicates()
    )


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while every sum fits, else in Python integers."""
    top = int(np.abs(x.astype("f8")).max(initial=0)) * int(np.abs(q.astype("f8")).max(initial=0)) * max(1, x.shape[1])
    if top < 1 << 52:
        return (x.astype("f8") @ q.astype("f8").T).astype("i8")
    if top < 1 << 62:
        return x @ q.T
    return np.clip(x.astype(object) @ q.astype(object).T, -(1 << 62), (1 << 62) - 1).astype("i8")


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Class ids and components of a batch, one matrix per vector length, a few rows at a time."""
    ids, lists = batch.column("cls").to_numpy(zero_copy_only=False), batch.column("comps")
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        part = lists.take(pa.array(at))
        yield ids[at], part.flatten().to_numpy(zero_copy_only=False).reshape(len(at), int(dim))


class _Chunk:
    """Queries of one length: their numbers and components, and the partial scores of rows against them."""

    def __init__(self, numbers: np.ndarray, comps: np.ndarray, slices: int):
        self.numbers, self.comps, self.dim = numbers, comps, comps.shape[1]
        self.cuts = np.array_split(np.arange(self.dim), slices)

    def partial(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        rows = max(1, SCORES_PER_STEP // max(1, len(self.numbers)))
        for batch in batches:
            for ids, x in _matrices(batch):
                if x.shape[1] == self.dim:
                    for i in range(0, len(ids), rows):
                        y = x[i : i + rows]
                        yield ids[i : i + rows], [_products(y[:, c], self.comps[:, c]) for c in self.cuts]


def _best(keep: int, score: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
    """The ``keep`` greatest scores of each column, with what stands beside them."""
    if len(score) <= keep:
        return score, *others
    at = np.argpartition(-score, keep - 1, axis=0)[:keep]
    return tuple(np.take_along_axis(x, at, 0) for x in (score, *others))


def _local_lists(chunk: _Chunk, keep: int):
    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list = [None] * len(chunk.cuts)
        for ids, scores in chunk.partial(batches):
            total = sum(scores)
            for j, s in enumerate(scores):
                held, low = _best(keep, s, np.broadcast_to(ids[:, None], s.shape), total), s.min(axis=0)
                if state[j] is not None:
                    held = _best(keep, *(np.vstack(x) for x in zip(state[j][0], held)))
                    low = np.minimum(low, state[j][1])
                state[j] = (held, low)
        for j, kept in enumerate(state):
            if kept is not None:
                (best, who, total), low = kept
                n = len(best)
                yield pa.RecordBatch.from_pydict({
                    "qc": np.tile(chunk.numbers, n), "slice": np.full(best.size, j, "i4"), "cls": who.reshape(-1),
                    "score": best.reshape(-1), "total": total.reshape(-1), "low": np.tile(low, n),
                })

    return lists


def _sufficient(chunk: _Chunk, low: np.ndarray, need: np.ndarray):
    """Entries whose share of the cutoff is reached: (score - slice minimum) * slices >= what the sum needs."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, scores in chunk.partial(batches):
            for j, s in enumerate(scores):
                over = s - low[:, j]
                row, col = np.nonzero(over * len(scores) >= need)
                if len(row):
                    yield pa.RecordBatch.from_pydict({
                        "qc": chunk.numbers[col], "cls": ids[row], "slice": np.full(len(row), j, "i4"), "over": over[row, col],
                    })

    return entries


def _resolved(chunk: _Chunk):
    place = {int(n): i for i, n in enumerate(chunk.numbers)}

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("comps").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, chunk.dim)
                qc = batch.column("qc").to_numpy(zero_copy_only=False)
                out = np.empty(len(qc), "i8")
                for n in np.unique(qc):
                    at = qc == n
                    out[at] = _products(x[at], chunk.comps[place[int(n)]][None])[:, 0]
                yield pa.RecordBatch.from_pydict({"qc": qc, "cls": batch.column("cls"), "score": out})

    return scores


def _kth(groups: pd.DataFrame, numbers: np.ndarray, keep: int, default: np.ndarray) -> np.ndarray:
    """The keep-th greatest ``bound`` per query, or the default where there are fewer."""
    ranked = groups.sort_values(["qc", "bound"], ascending=[True, False])
    at = ranked[ranked.groupby("qc").cumcount() == keep - 1].set_index("qc")["bound"]
    return at.reindex(numbers).fillna(pd.Series(default, numbers)).to_numpy().astype("i8")


def _search(classes: DataFrame, chunk: _Chunk, keep: int) -> DataFrame:
    """(qc, cls, score) of all classes that can be among the ``keep`` best of a query of the chunk."""
    spark, m = classes.sparkSession, len(chunk.cuts)
    rows = classes.select("cls", "comps")
    # 1: gather local lists; what reaches the driver has at most slices * keep rows per query of the chunk
    lists = rows.mapInArrow(_local_lists(chunk, keep), "qc long, slice int, cls long, score long, total long, low long")
    lists = written(lists, "topk-lists")
    order = Window.partitionBy("qc", "slice").orderBy(F.desc("score"))
    seen = lists.select("qc", "slice", "cls", "score", "total").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= keep).toPandas()
    lows = lists.groupBy("qc", "slice").agg(F.min("low").alias("low")).toPandas()
    if not len(lows):
        return spark.createDataFrame([], "qc long, cls long, score long")
    low = lows.pivot(index="qc", columns="slice", values="low").reindex(chunk.numbers).to_numpy().astype("i8")
    floor = low.sum(axis=1)
    known = seen.drop_duplicates(["qc", "cls"]).rename(columns={"total": "bound"})
    need = _kth(known, chunk.numbers, keep, floor) - floor
    # 2: the cutoff goes out, sufficient entries come back
    entries = rows.mapInArrow(_sufficient(chunk, low, need), "qc long, cls long, slice int, over long")
    cut = pd.DataFrame({"qc": chunk.numbers, "floor": floor, "most": -(-need // m) - 1})
    cut = F.broadcast(spark.createDataFrame(cut, "qc long, floor long, most long"))
    sums = entries.groupBy("qc", "cls").agg(F.sum("over").alias("bound"), F.count("*").alias("known"))
    sums = written(sums.join(cut, "qc"), "topk-entries")
    best = sums.withColumn("n", F.row_number().over(Window.partitionBy("qc").orderBy(F.desc("bound")))).filter(F.col("n") <= keep)
    sharper = _kth(best.select("qc", "bound").toPandas(), chunk.numbers, keep, need)
    sharp = F.broadcast(spark.createDataFrame(pd.DataFrame({"qc": chunk.numbers, "sharp": sharper}), "qc long, sharp long"))
    # 3: missing partial scores of what is left
    upper = F.col("bound") + (m - F.col("known")) * F.greatest(F.col("most"), F.lit(0))
    left = sums.join(sharp, "qc").filter(upper >= F.col("sharp"))
    whole = left.filter(F.col("known") == m).select("qc", "cls", (F.col("bound") + F.col("floor")).alias("score"))
    rest = left.filter(F.col("known") < m).select("qc", "cls").join(rows, "cls").select("qc", "cls", "comps")
    return whole.unionByName(rest.mapInArrow(_resolved(chunk), "qc long, cls long, score long"))


def _chunks(queries: DataFrame, slices: int) -> Iterator[_Chunk]:
    held: dict[int, list] = {}
    for row in queries.toLocalIterator():
        dim = len(row["comps"])
        mine = held.setdefault(dim, [])
        mine.append(row)
        if len(mine) * 8 * max(dim, 8) >= CHUNK_BYTES:
            yield _chunk(held.pop(dim), dim, slices)
    for dim, mine in held.items():
        yield _chunk(mine, dim, slices)


def _chunk(rows: list, dim: int, slices: int) -> _Chunk:
    comps = np.array([r["comps"] for r in rows], dtype="i8").reshape(len(rows), dim)
    return _Chunk(np.array([r["qc"] for r in rows], dtype="i8"), comps, max(1, min(slices, dim)))


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 10, slices: int = 2, id_col: str = "vec_id",
               vector_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of each query row with all other rows.

    ``is_query`` is a condition on ``vec_id``. Exact for any ``slices``; more of them weaken the cutoff.
    """
    spark, keep = vectors.sparkSession, k + 1
    rows = quantised(vectors, id_col, vector_col, scale)
    smallest = Window.partitionBy("comps").orderBy("vec_id")
    classes = written(
        rows.withColumn("n", F.row_number().over(smallest)).filter(F.col("n") <= keep)
        .groupBy("comps").agg(F.collect_list("vec_id").alias("ids")).withColumn("cls", F.monotonically_increasing_id()),
        "topk-classes",
    )
    asked = rows.filter(is_query)
    queries = written(asked.select("comps").distinct().withColumn("qc", F.monotonically_increasing_id()), "topk-queries")
    # few rows in small chunks; a chunk's result is written before the next one starts
    out = work_folder(spark, "topk-found")
    members = classes.select("cls", "ids")
    ranked = Window.partitionBy("qc").orderBy(F.desc("score"), "vec_id")
    none = spark.createDataFrame([], "qc long, vec_id long, score long")
    none.write.parquet(f"{out}/found")
    for chunk in _chunks(queries, slices):
        found = _search(classes, chunk, keep).join(members, "cls").select("qc", "score", F.explode("ids").alias("vec_id"))
        found = found.withColumn("n", F.row_number().over(ranked)).filter(F.col("n") <= keep).drop("n")
        found.select("qc", "vec_id", "score").write.mode("append").parquet(f"{out}/found")
    found = spark.read.schema(none.schema).parquet(f"{out}/found")
    final = Window.partitionBy("query_id", "qc").orderBy(F.desc("score"), "vec_id")
    return (
        asked.join(queries, "comps").select(F.col("vec_id").alias("query_id"), "qc").join(found, "qc")
        .filter(F.col("vec_id") != F.col("query_id"))
        .withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
