"""Benchmark items in documents, found by exact pieces and verified by bit-parallel edit distance.

An item of m code points may occur with up to floor(rate * m) edits. Cut into one piece more than that, at
least one piece occurs unchanged. One automaton looks for all pieces of all items in each text; around
the hits, Myers' algorithm computes the edit distance of the item to the best stretch of text.

Every text is scanned once, whole, for each ``ITEM_CHARS`` of benchmark text; only such a portion of items is
sent to the tasks at a time. Nothing is shuffled.

White space compares as spaces, and texts with runs of it are read a second time with each run as one space, so
that another layout takes nothing from the budget; so are items with runs. Places are those of the text as it stands.

Defined results: letters compare without case where lower-casing keeps the length; a null item, one of
white space only and a null text match nothing; a null id of a document stays null; an item without an id is not reported
by ``matches``, whose rows name an item, and counts in ``without_matches``; repeated rows are reported each; of several occurrences of an
item in a text the one with the least distance, then the first, is reported; several texts under one item id
are reported as the best of them, whichever portions hold them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dirlens.llm.common import texts

RATE = 0.07
ITEM_CHARS = 8 << 20
_SPACE, _RUN = re.compile(r"\s"), re.compile(" {2,}")
# A character that is white space neither for Java nor for Python.
_NOT_BLANK = r"(?U)[^\s\x1c-\x1f]"


def folded(text: str) -> str:
    """Lower case, letter by letter where the whole would change its length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def layouts(text: str) -> Iterator[tuple[str, list[int], list[int]]]:
    """The text with white space as spaces; then, if it has runs, with each run as one space.

    With it the places of the runs and how much longer the text is after each.
    """
    even = _SPACE.sub(" ", text)
    yield even, [], [0]
    if "  " in even:
        places, longer = [], [0]
        for m in _RUN.finditer(even):
            places.append(m.start() - longer[-1])
            longer.append(longer[-1] + m.end() - m.start() - 1)
        yield _RUN.sub(" ", even), places, longer


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of nearly equal length with their places."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def _masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def distances(item: str, text: str, anchored: bool = False) -> Iterator[int]:
    """After each code point of the text, the edit distance of the item to the best stretch that ends there.

    With ``anchored`` the stretch starts with the text. Myers' bit vectors, one Python integer each.
    """
    masks, m = _masks(item), len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    for c in text:
        equal = masks.get(c, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (~(horizontal | plus) & full)
        down = plus & horizontal
        score += bool(up & top) - bool(down & top)
        up = (up << 1 | anchored) & full
        down = down << 1 & full
        plus = down | (~(vertical | up) & full)
        minus = up & vertical
        yield score


def best_stretch(item: str, text: str, budget: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the nearest stretch of the text, the first to end; None beyond the budget."""
    at = text.find(item)
    if at >= 0:
        return 0, at, at + len(item)
    found = min(((d, i) for i, d in enumerate(distances(item, text), 1)), default=(budget + 1, 0))
    if found[0] > budget:
        return None
    distance, end = found
    tail = text[max(0, end - len(item) - distance) : end]
    back = distances(item[::-1], tail[::-1], anchored=True)
    length = next(i for i, d in enumerate(back, 1) if d == distance)
    return distance, end - length, end


class Matcher:
    """Finds a portion of items, (id, text), in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = list(dict.fromkeys((key, layout) for key, text in items for layout, _, _ in layouts(folded(text))))
        self.budgets = [int(len(text) * rate) for _, text in self.items]
        self.automaton = ahocorasick.Automaton()
        for n, (_, text) in enumerate(self.items):
            for at, piece in pieces(text, self.budgets[n]):
                if not self.automaton.exists(piece):
                    self.automaton.add_word(piece, [])
                self.automaton.get(piece).append((n, at + len(piece) - 1))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end), the best per item id."""
        best: dict[int, tuple[int, int, int]] = {}
        for layout, places, longer in layouts(folded(text)):
            for key, distance, start, end in self._find(layout):
                start, end = (at + longer[bisect_left(places, at)] for at in (start, end))
                best[key] = min(best.get(key, (distance, start, end)), (distance, start, end))
        return [(key, *found) for key, found in best.items()]

    def _find(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        starts: dict[int, list[int]] = {}
        for end, hits in self.automaton.iter(text):
            for n, at in hits:
                starts.setdefault(n, []).append(end - at)
        for n, near in starts.items():
            key, item = self.items[n]
            for low, high in self._windows(near, n, len(text)):
                if found := best_stretch(item, text[low:high], self.budgets[n]):
                    yield key, found[0], low + found[1], low + found[2]

    def _windows(self, near: list[int], n: int, size: int) -> Iterator[tuple[int, int]]:
        """Stretches of text around the places where hits put the item's start, overlapping ones joined."""
        reach, length = self.budgets[n], len(self.items[n][1])
        low = high = None
        for start in sorted(set(near)):
            a, b = max(0, start - reach), min(size, start + length + reach)
            if high is not None and a <= high:
                high = max(high, b)
                continue
            if high is not None:
                yield low, high
            low, high = a, b
        yield low, high


def portions(items: DataFrame, id_col: str, text_col: str, named: bool = True) -> Iterator[list[tuple[int | None, str]]]:
    """The items, or those that have an id, in lists of at most about ``ITEM_CHARS``; one list is on the driver at a time."""
    rows = texts(items, id_col, text_col).filter(F.col("text").rlike(_NOT_BLANK)).dropDuplicates()
    if named:
        rows = rows.filter(F.col("doc_id").isNotNull())
    held, size = [], 0
    for row in rows.toLocalIterator():
        held.append((row["doc_id"], row["text"]))
        size += len(row["text"])
        if size >= ITEM_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def matches(docs: DataFrame, items: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text",
            item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, start, end): every item that occurs in a document; code points, end exclusive."""
    schema = "doc_id long, item_id long, distance int, start long, end long, uid long"
    rows = texts(docs, id_col, text_col).withColumn("uid", F.monotonically_increasing_id())
    found_in = []
    for portion in portions(items, item_id_col, item_text_col):

        def scan(batches: Iterator[pa.RecordBatch], portion=portion) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(portion, rate)
            for batch in batches:
                found = [
                    (doc, *hit, uid) for doc, text, uid in zip(*(c.to_pylist() for c in batch.columns)) for hit in matcher.find(text)
                ]
                columns = zip(*found) if found else [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "distance", "start", "end", "uid"]
                )

        found_in.append(rows.mapInArrow(scan, schema))
    if len(found_in) < 2:
        return (found_in or [docs.sparkSession.createDataFrame([], schema)])[0].drop("uid")
    # the texts of one item may lie in several portions: the best of them, for each row of the documents
    best = F.min(F.struct("distance", "start", "end")).alias("best")
    return reduce(DataFrame.unionByName, found_in).groupBy("uid", "doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def without_matches(docs: DataFrame, items: DataFrame, rate: float = RATE, text_col: str = "text",
                    item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents in which no item occurs, with all their columns."""
    place = docs.columns.index(text_col)
    for portion in portions(items, item_id_col, item_text_col, named=False):

        def clean(batches: Iterator[pa.RecordBatch], portion=portion) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(portion, rate)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(t or "") for t in batch.column(place).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
