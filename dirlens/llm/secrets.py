"""Secrets in texts, found through a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over the trigrams that any match must
contain. A block of documents is indexed by these trigrams; the query intersects and unites postings, and
the expression runs only over the documents that are left. A rule without a mandatory trigram reads all.

The index covers a block of ``BLOCK_BYTES`` of text and lives as long as the block. An index of the whole
corpus would have to be written, shuffled and joined back with texts that one scan reads anyway.

Defined results: a null text is empty and has no spans; a null id stays null; repeated rows are repeated;
offsets count code points, the end is exclusive; matches are leftmost and do not overlap within a rule.
"""

from __future__ import annotations

import re
import re._parser as parser
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dirlens.llm.common import texts

BLOCK_BYTES = 4 << 20
#: A set of alternatives longer than this is not followed letter by letter.
MOST_STRINGS = 24


@dataclass(frozen=True)
class Rule:
    """``least``: the least length of group ``group`` in a match that counts."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False
    search: re.Pattern = field(init=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "search", re.compile(self.pattern, re.ASCII))

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.search.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


# The base rules, and published formats of keys.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]{10,250}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"(?i:bearer) [A-Za-z0-9._~+/-]{20,}"),
)

# A query is True (any text), a trigram, or ("and" | "or", queries).
Query = object


def _all(parts: list) -> Query:
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list) -> Query:
    parts = list(dict.fromkeys(parts))
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]) -> Query:
    """What holds for a text that contains one of the strings."""
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _joined(left: set[str], right: set[str]) -> set[str] | None:
    return {a + b for a in left for b in right} if len(left) * len(right) <= MOST_STRINGS else None


def _analysed(items) -> tuple[set[str] | None, Query]:
    """All strings that the items match if these are few, and a query for them."""
    run, parts, exact = {""}, [], True
    for op, arg in items:
        strings, query = _element(str(op), arg)
        longer = _joined(run, strings) if strings is not None else None
        if longer is not None:
            run = longer
        else:
            parts += [_of_strings(run), query]
            run, exact = {""}, False
    return (run if exact else None), _all([*parts, _of_strings(run)])


def _element(op: str, arg) -> tuple[set[str] | None, Query]:
    if op == "LITERAL":
        strings = {chr(arg).lower()}
        return strings, _of_strings(strings)
    if op == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
        strings = {chr(c).lower() for _, c in arg}
        return (strings, True) if len(strings) <= MOST_STRINGS else (None, True)
    if op == "SUBPATTERN":
        return _analysed(arg[3])
    if op == "BRANCH":
        found = [_analysed(x) for x in arg[1]]
        strings = set().union(*(s for s, _ in found)) if all(s is not None for s, _ in found) else None
        if strings is not None and len(strings) <= MOST_STRINGS:
            return strings, _of_strings(strings)
        return None, _any([q for _, q in found])
    if op in ("MAX_REPEAT", "MIN_REPEAT"):
        least, most, inner = arg
        strings, query = _analysed(inner)
        if least == 0:
            return (strings | {""} if most == 1 and strings is not None else None), True
        if least == most and strings is not None:
            out = {""}
            for _ in range(least):
                out = _joined(out, strings) if out is not None else None
            if out is not None:
                return out, _of_strings(out)
        return None, query
    return None, True


def _ascii(query: Query) -> Query:
    """The query without trigrams that have other letters: texts are indexed by bytes, and such letters are several."""
    if query is True or isinstance(query, str):
        return query if query is True or query.isascii() else True
    return (_all if query[0] == "and" else _any)([_ascii(q) for q in query[1]])


def trigram_query(pattern: str) -> Query:
    """The Boolean query, over lower-cased trigrams of ASCII characters, that every text with a match satisfies."""
    return _ascii(_analysed(parser.parse(pattern))[1])


def trigrams(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


class Index:
    """Postings of some trigrams over a block of texts: for each, the sorted numbers of the texts that have it."""

    def __init__(self, wanted: list[str]):
        self.wanted = wanted
        self.number = np.zeros(1 << 24, "u2")
        for i, t in enumerate(wanted, 1):
            a, b, c = t.encode("latin-1")
            self.number[a << 16 | b << 8 | c] = i

    def build(self, block: list[bytes]) -> None:
        self.size = len(block)
        data = np.frombuffer(b"\0\0".join(block).lower() + b"\0\0", "u1").astype("u4")
        starts = np.cumsum([0, *(len(x) + 2 for x in block[:-1])])
        which = self.number[data[:-2] << 16 | data[1:-1] << 8 | data[2:]]
        at = np.flatnonzero(which)
        pairs = np.unique(which[at].astype("i8") * self.size + np.searchsorted(starts, at, "right") - 1)
        cut = np.searchsorted(pairs, np.arange(1, len(self.wanted) + 2) * self.size)
        self.postings = {t: pairs[cut[i] : cut[i + 1]] % self.size for i, t in enumerate(self.wanted)}

    def matching(self, query: Query) -> np.ndarray:
        if query is True:
            return np.arange(self.size)
        if isinstance(query, str):
            return self.postings[query]
        found = [self.matching(q) for q in query[1]]
        out = found[0]
        for other in sorted(found[1:], key=len):
            out = np.intersect1d(out, other, True) if query[0] == "and" else np.union1d(out, other)
        return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    for batch in batches:
        ids, words = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        first, size = 0, 0
        for i, text in enumerate(words):
            size += len(text)
            if size >= BLOCK_BYTES or i + 1 == len(words):
                yield ids[first : i + 1], words[first : i + 1]
                first, size = i + 1, 0


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, first, last>>): every match of every rule, by start, then in the order of the rules."""
    queries = [(rule, trigram_query(rule.pattern)) for rule in rules]
    wanted = sorted(set().union(*(trigrams(q) for _, q in queries)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(wanted)
        kind = pa.struct([("kind", pa.string()), ("first", pa.int64()), ("last", pa.int64())])
        for ids, block in _blocks(batches):
            index.build([t.encode() for t in block])
            found: list[list] = [[] for _ in block]
            for n, (rule, query) in enumerate(queries):
                for i in index.matching(query).tolist():
                    found[i] += [(start, n, rule.kind, end) for start, end in rule.spans(block[i])]
            spans = [[{"kind": k, "first": s, "last": e} for s, _, k, e in sorted(x)] for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, pa.list_(kind))], ["doc_id", "spans"])

    return texts(docs, id_col, text_col).mapInArrow(scan, "doc_id long, spans array<struct<kind string, first long, last long>>")
