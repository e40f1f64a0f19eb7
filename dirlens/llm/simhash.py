"""Near-duplicate documents by SimHash and the generalised pigeonhole principle.

The 64 bits are cut into parts of correlated bits, and part i gets a threshold t_i of its own with
sum(t_i + 1) = maximum distance + 1: two fingerprints within the maximum distance then differ in at most t_i bits
of some part. Parts and thresholds come from dynamic programming on estimated candidate counts, taken from the bit
counts of all fingerprints. Every fingerprint probes the buckets of a part that its threshold reaches, and candidates
are verified by their distance.

Components, not pairs, are asked for, so a large group is never paired with itself: fingerprints that equal each
other are one node, each bucket first links its members to two hubs, and only members of different components
are compared after that, less the largest component of a bucket with itself.

Defined results: a null text is empty; a text without words has the fingerprint zero and links like any other; a null
id stays null and never names a component that has another id; repeated rows are repeated; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirlens.llm.common import texts, written

BITS = 64
SEED = 42
#: Hashes that are turned into bits at a time.
STEP = 1 << 17
#: Cost of sending one probe, in units of comparing one pair.
PROBE_COST = 60.0


def shingle_hashes(words: list[bytes], length: int) -> Iterator[np.ndarray]:
    """The hashes of all shingles, repeats included, a bounded number at a time."""
    digest = xxhash.xxh64_intdigest
    if len(words) <= length:
        if words:
            yield np.array([digest(b" ".join(words), SEED)], "<u8")
        return
    for first in range(0, len(words) - length + 1, STEP):
        some = words[first : first + STEP + length - 1]
        line = b" ".join(some)
        ends = np.cumsum([len(w) + 1 for w in some])
        starts = (ends - [len(w) + 1 for w in some]).tolist()
        stops = (ends[length - 1 :] - 1).tolist()
        yield np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops)], "<u8")


def fingerprints(docs: DataFrame, length: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): a bit is set if over half of the shingle hashes have it."""
    capitals = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

    def majority(hashes: list[np.ndarray], owner: list[int], ones: np.ndarray, total: np.ndarray) -> None:
        """Adds the bits of the hashes to the counts of the texts that own them."""
        sizes = np.array([len(h) for h in hashes])
        bits = np.unpackbits(np.concatenate(hashes).view("u1"), bitorder="little").reshape(-1, BITS)
        sums = np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0, dtype="u4")
        np.add.at(ones, owner, sums)
        np.add.at(total, owner, sizes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ones, total = np.zeros((batch.num_rows, BITS), "i8"), np.zeros(batch.num_rows, "i8")
            hashes, owner, held = [], [], 0
            for i, text in enumerate(batch.column(1)):
                words = text.as_py().encode().translate(capitals).split()
                for some in shingle_hashes(words, length):
                    hashes.append(some)
                    owner.append(i)
                    held += len(some)
                    if held >= STEP:
                        majority(hashes, owner, ones, total)
                        hashes, owner, held = [], [], 0
            if hashes:
                majority(hashes, owner, ones, total)
            fp = np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<i8").ravel()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return texts(docs, id_col, text_col).mapInArrow(scan, "doc_id long, fp long")


def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and for each pair of bits how many have both set."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS), "i8"), 0
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for i in range(0, len(fp), STEP):
                bits = np.unpackbits(fp[i : i + STEP].astype("<i8").view("u1"), bitorder="little").reshape(-1, BITS).astype("f4")
                both += (bits.T @ bits).astype("i8")
                n += len(bits)
        if n:
            i, j = np.nonzero(both)
            yield pa.RecordBatch.from_pydict({"i": np.append(i, -1), "j": np.append(j, -1), "n": np.append(both[i, j], n)})

    rows = nodes.select("fp").mapInArrow(count, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    total, both = 0, np.zeros((BITS, BITS))
    for r in rows:
        if r["i"] < 0:
            total = r["n"]
        else:
            both[r["i"], r["j"]] = r["n"]
    return total, both


def correlated_parts(total: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The bits in m parts of nearly equal size; each part starts with the least biased free bit and takes its closest ones."""
    share = np.diag(both) / max(total, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    close = np.abs(both / max(total, 1) - np.outer(share, share)) / np.outer(spread, spread)
    free, parts = list(range(BITS)), []
    for p in range(m):
        size = (BITS * (p + 1)) // m - (BITS * p) // m
        part = [max(free, key=lambda b: (spread[b], -b))]
        while len(part) < size:
            part.append(max((b for b in free if b not in part), key=lambda b: (close[b, part].sum(), -b)))
        free = [b for b in free if b not in part]
        parts.append(sorted(part))
    return parts


def allocate(total: int, share: np.ndarray, parts: list[list[int]], most: int) -> tuple[float, list[int]]:
    """Thresholds with sum(t + 1) = most + 1 and the least estimated cost; -1 leaves a part out."""
    total, costs = max(total, 1), []
    for part in parts:
        near = np.array([1.0])
        for b in part:
            differ = 2 * share[b] * (1 - share[b])
            near = np.convolve(near, [1 - differ, differ])
        reach = np.cumsum(near)
        probes = np.cumsum([comb(len(part), r) for r in range(most + 1)])
        costs.append([0.0, *(PROBE_COST * total * probes[t] + float(total) ** 2 * reach[min(t, len(part))] for t in range(most + 1))])
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        best = {
            s: min((best[s - u][0] + c, [*best[s - u][1], u - 1]) for u, c in enumerate(cost) if s - u in best)
            for s in range(most + 2) if any(s - u in best for u in range(len(cost)))
        }
    return best.get(most + 1, (float("inf"), []))


def plan(nodes: DataFrame, most: int) -> list[tuple[int, list[int]]]:
    """(mask, flips) per part that is probed: flips are what a probe may differ by within the mask."""
    total, both = bit_counts(nodes)
    share = np.diag(both) / max(total, 1)
    options = [(*allocate(total, share, parts, most), parts) for parts in (correlated_parts(total, both, m) for m in range(1, most + 2))]
    _, thresholds, parts = min(options, key=lambda o: o[0])
    signed = lambda bits: int(np.uint64(sum(1 << b for b in bits)).astype("i8"))
    return [
        (signed(part), [signed(c) for r in range(t + 1) for c in combinations(part, r)]) for part, t in zip(parts, thresholds) if t >= 0
    ]


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component of the edges (a, b), by alternating large and small stars."""
    a, b = F.col("a"), F.col("b")
    mark = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), a).alias("m")), "stars")
        large = both.filter(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b"))
        large = written(large.filter(a != b).distinct(), "stars")
        # every edge now leads from a greater node a to a smaller node b
        small = written(large.groupBy("a").agg(F.min("b").alias("m")), "stars")
        linked = large.join(small, "a").select(b.alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        edges = written(linked.filter(a != b).distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            return edges.select(a.alias("node"), b.alias("root"))
        mark = tuple(now)
    return edges.select(a.alias("node"), b.alias("root"))


def _distance(x: str, y: str) -> Column:
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y)))


def linked(nodes: DataFrame, most: int) -> DataFrame:
    """(fp, root): the component of each distinct fingerprint of ``nodes`` (fp, copies), named by its smallest."""
    parts = plan(nodes, most)
    if not parts:
        return nodes.select("fp", F.col("fp").alias("root"))
    every = F.array(*(F.struct(F.lit(i).alias("part"), F.lit(mask).alias("mask")) for i, (mask, _) in enumerate(parts)))
    index = nodes.select("fp", "copies", F.explode(every).alias("p")).select(
        "fp", "copies", "p.part", F.col("fp").bitwiseAND(F.col("p.mask")).alias("value")
    )
    flips = F.array(*(
        F.struct(F.lit(i).alias("part"), F.lit(mask).alias("mask"), F.array(*map(F.lit, few)).alias("flips")) for i, (mask, few) in enumerate(parts)
    ))
    probes = (
        nodes.select("fp", F.explode(flips).alias("p")).select("fp", "p.part", "p.mask", F.explode("p.flips").alias("flip"))
        .select("fp", "part", "flip", F.col("fp").bitwiseAND(F.col("mask")).bitwiseXOR(F.col("flip")).alias("value"))
    )
    key = ["part", "value"]
    # stars: every probe is compared with the two hubs of the bucket it reaches
    hubs = index.groupBy(*key).agg(
        F.max(F.struct("copies", F.xxhash64("fp").alias("h"), "fp"))["fp"].alias("hub"), F.max(F.struct(F.xxhash64("fp", F.lit(1)).alias("h"), "fp"))["fp"].alias("other"),
    )
    near = probes.join(written(hubs, "simhash-hubs"), key).select(
        "fp", F.explode(F.filter(F.array("hub", "other"), lambda h: (h != F.col("fp")) & (F.bit_count(h.bitwiseXOR(F.col("fp"))) <= most))).alias("hub")
    )
    edges = near.select(F.greatest("fp", "hub").alias("a"), F.least("fp", "hub").alias("b")).distinct()
    first = written(_rooted(nodes, components(written(edges, "simhash-stars"))), "simhash-first")
    # the rest: members of different components that meet in a bucket
    placed = index.join(first, "fp").select("fp", "root", *key)
    sizes = placed.groupBy(*key, "root").agg(F.count("*").alias("n"))
    buckets = written(
        sizes.groupBy(*key).agg(F.max(F.struct("n", "root"))["root"].alias("largest"), F.count("*").alias("roots")), "simhash-buckets"
    )
    mixed = (F.col("roots") > 1) & (F.col("root") != F.col("largest"))
    reached = (F.col("roots") > 1) | (F.col("root") != F.col("largest"))
    asking = written(
        probes.join(first, "fp").join(buckets, key).filter(F.when(F.col("flip") == 0, mixed).otherwise(reached))
        .select(*key, F.col("fp").alias("mine"), F.col("root").alias("my_root")), "simhash-asking",
    )
    asked = asking.select(*key).distinct()
    there = written(placed.join(asked, key, "left_semi"), "simhash-asked")
    met = asking.join(there, key).filter((F.col("root") != F.col("my_root")) & (_distance("mine", "fp") <= most))
    across = met.select(F.greatest("root", "my_root").alias("a"), F.least("root", "my_root").alias("b")).distinct()
    second = components(written(across, "simhash-across")).select(F.col("node").alias("root"), F.col("root").alias("last"))
    return first.join(second, "root", "left").select("fp", F.coalesce("last", "root").alias("root"))


def _rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, length: int = 4, most: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints are linked by chains of at most ``most`` differing bits."""
    prints = written(fingerprints(docs, length, id_col, text_col), "simhash-prints")
    nodes = written(prints.groupBy("fp").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least")), "simhash-nodes")
    roots = written(linked(nodes.select("fp", "copies"), most), "simhash-roots")
    names = nodes.join(roots, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(roots.join(written(names, "simhash-names"), "root").select("fp", "component_id"), "simhash-named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, length: int = 4, most: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all columns, whose id is the smallest of a component.

    Rows that share an id are one document and stay or go together; rows without an id stay.
    """
    found = written(near_duplicates(docs, length, most, id_col, text_col), "simhash-found")
    known = found.filter(F.col("doc_id").isNotNull())
    drop = known.groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("drop")).filter("drop")
    drop = drop.select(F.col("doc_id").alias("_dropped_id"))
    return docs.join(drop, docs[id_col].cast("long") == drop["_dropped_id"], "left_anti")
