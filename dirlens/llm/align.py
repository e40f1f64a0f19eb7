"""Token ids of two tokenizers over the same texts, aligned by the bytes that they stand for.

Both tokenizers spell a text as bytes. Where tokens of both end at the same byte, the text is cut; what lies between two cuts is
a group, and the two tokens that end there are linked. How often an id pair is linked is counted over all documents.

Alignment is a fold over an associative monoid. The ``Fragment`` of a byte range has an open head (tokens up to its first
cut), closed groups, and an open tail (tokens after its last cut); of two neighbours the tail of one and the head of the other
make a group, or go on being open where a range has no cut at all.

* A text of at most ``PIECE`` code points is one row. Both tokenizers treat words that follow a single space alone, so the
  fragments of distinct words are found once by a task; they are closed on both sides, and composing them is writing them
  behind each other.
* A longer text is cut at such spaces into pieces that go to different tasks. Tokens of a piece are cut into ranges of
  ``RANGE`` bytes of the document, wherever these cut groups; the fragments are composed in a tree, ``FAN`` ranges at a
  time, level by level, so that no task holds more than what it composes.

Pair counts are added up in each task before they are shuffled. The pairs that are linked most often, at most ``FREQUENT``, go to
all tasks; links of other pairs are joined with their counts, and none of these is a hot key, as all are rare.

Defined results: a null or empty text, and one that a tokenizer doesn't spell as it is, has no tokens: zeros and an empty
digest; a null id stays null; repeated rows are documents of their own and count as such; other columns are not looked at;
without documents there are no rows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from dirlens.llm.common import setting, texts, written

#: Code points of a text, and of a piece of a longer one, that a task takes at a time.
PIECE = 1 << 16
#: Bytes of a document whose tokens make one fragment.
RANGE = 1 << 14
#: Ranges that are composed at a time.
FAN = 8
#: A Python worker keeps the fragments of twice as many words.
CACHED = 130_000
#: Id pairs whose counts are sent to all tasks.
FREQUENT = 1 << 20
#: New words that are tokenized at a time.
_JOINED = 256
#: Links whose pairs a task counts at a time.
_COUNTED = 1 << 20
#: Texts or pieces that a task is sent at a time.
_BATCH = 200

#: A space that both tokenizers treat as the beginning of a word: alone, and before something that isn't white space.
_SPACE = re.compile(r"(?<=[^ ]) (?=\S)")
#: Spaces that aren't.
_OTHER = re.compile(r"^ | (?:\s|$)")

_KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
_DOC = "doc_id long, n_a long, n_b long, n_groups long, links binary, groups_sha256 string"
_PART = (
    "uid long, doc_id long, range long, piece int, ok boolean, n_a long, n_b long, cut boolean, head_a binary, head_b binary, "
    "closed binary, links binary, tail_a binary, tail_b binary"
)


def byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 ones for themselves, then from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Pair:
    """Both tokenizers, and the bytes of their ids."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        letters, vocabulary = byte_letters(), self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.bytes_a[i] = bytes(map(letters.__getitem__, entry)) if all(c in letters for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.lengths_a, self.lengths_b = (np.array(list(map(len, x)), "i8") for x in (self.bytes_a, self.bytes_b))
        n_a, n_b = self.n_a, self.n_b = len(self.bytes_a), len(self.bytes_b)
        #: A link is one number: a * n_b + b.
        self.code = "<u4" if n_a * n_b < 1 << 32 else "<u8"
        # tokens within a group, and a group's last one, of either tokenizer; the marks tell them apart until the digest
        self.written = [b"%d%s" % (i, mark) for n, marks in ((n_a, b".|"), (n_b, b",;")) for mark in (marks[:1], marks[1:]) for i in range(n)]

    def encode(self, spans: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of a space and each span."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + s for s in spans], add_special_tokens=False)]
        return a, self.b.encode(spans, num_threads=1)

    def spells(self, span: str, a: list[int], b: list[int]) -> bool:
        """Both give the bytes of a space and the span."""
        raw = (" " + span).encode()
        return b"".join(map(self.bytes_a.__getitem__, a)) == raw and b"".join(map(self.bytes_b.__getitem__, b)) == raw

    def spelled(self, spans: list[str], a: list[list[int]], b: list[list[int]]) -> list[int]:
        """The numbers of the spans that both spell, found at once where it is all of them."""
        raw = [(" " + s).encode() for s in spans]
        sizes, all_raw = np.array(list(map(len, raw))), b"".join(raw)
        for ids, spelling, lengths in ((a, self.bytes_a, self.lengths_a), (b, self.bytes_b, self.lengths_b)):
            flat = list(chain.from_iterable(ids))
            n = np.array(list(map(len, ids)))
            ends = np.concatenate([[0], np.cumsum(lengths[np.array(flat, "i8")])])[np.cumsum(n)]
            if not np.array_equal(ends, np.cumsum(sizes)) or b"".join(map(spelling.__getitem__, flat)) != all_raw:
                return [i for i, s in enumerate(spans) if self.spells(s, a[i], b[i])]
        return list(range(len(spans)))


@dataclass
class Fragment:
    """The alignment of a byte range. Ids are decimal, each with its mark: a dot or a comma by tokenizer, or the end of a group."""

    n_a: int = 0
    n_b: int = 0
    cut: bool = False
    head_a: bytes = b""
    head_b: bytes = b""
    closed: bytes = b""
    links: bytes = b""
    tail_a: bytes = b""
    tail_b: bytes = b""


def group(pair_code: tuple[int, str], a: bytes, b: bytes) -> tuple[bytes, bytes]:
    """A closed group of open ids, and its link."""
    n_b, code = pair_code
    last = [int(x[:-1].rpartition(mark)[2]) for x, mark in ((a, b"."), (b, b","))]
    return a[:-1] + b"|" + b[:-1] + b";", np.array([last[0] * n_b + last[1]], code).tobytes()


def compose(pair_code: tuple[int, str], x: Fragment, y: Fragment) -> Fragment:
    """Two neighbouring fragments as one; associative, and ``Fragment()`` changes nothing."""
    n_a, n_b = x.n_a + y.n_a, x.n_b + y.n_b
    if not x.cut:
        return Fragment(n_a, n_b, y.cut, x.head_a + y.head_a, x.head_b + y.head_b, y.closed, y.links, y.tail_a, y.tail_b)
    if not y.cut:
        return Fragment(n_a, n_b, True, x.head_a, x.head_b, x.closed, x.links, x.tail_a + y.head_a, x.tail_b + y.head_b)
    text, link = group(pair_code, x.tail_a + y.head_a, x.tail_b + y.head_b)
    return Fragment(n_a, n_b, True, x.head_a, x.head_b, x.closed + text + y.closed, x.links + link + y.links, y.tail_a, y.tail_b)


def whole(pair_code: tuple[int, str], x: Fragment) -> tuple[bytes, bytes]:
    """All groups and links of a fragment that is a whole document: its head begins at the beginning, and its end is a cut."""
    if not x.cut:
        return b"", b""
    text, link = group(pair_code, x.head_a, x.head_b)
    return text + x.closed, link + x.links


def _marked(ids: np.ndarray, groups: np.ndarray, first: int, n: int) -> np.ndarray:
    """Numbers of written ids: of their last form where a group ends."""
    last = np.ones(len(ids), bool)
    last[:-1] = groups[1:] != groups[:-1]
    return first + ids + n * last


def aligned(pair: Pair, a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray, cuts: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Ids as written in groups, where each group's begin, and the groups' links; both id lists end at the last cut."""
    of_a, of_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    n_a, n_b = np.bincount(of_a, minlength=len(cuts)), np.bincount(of_b, minlength=len(cuts))
    till_a, till_b = np.cumsum(n_a), np.cumsum(n_b)
    order = np.empty(len(a) + len(b), "i8")
    order[np.arange(len(a)) + (till_b - n_b)[of_a]] = _marked(a, of_a, 0, pair.n_a)
    order[np.arange(len(b)) + till_a[of_b]] = _marked(b, of_b, 2 * pair.n_a, pair.n_b)
    links = (a[till_a - 1] * pair.n_b + b[till_b - 1]).astype(pair.code)
    return list(map(pair.written.__getitem__, order.tolist())), till_a + till_b - n_a - n_b, links


def fragment(pair: Pair, a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray) -> Fragment:
    """The fragment of the tokens that end in a byte range."""
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    open_a, open_b = (lambda ids, mark=mark: b"".join(b"%d%s" % (i, mark) for i in ids.tolist()) for mark in (b".", b","))
    if not len(cuts):
        return Fragment(len(a), len(b), False, open_a(a), open_b(b))
    head_a, head_b, tail_a, tail_b = (int(np.searchsorted(e, c, "right")) for c in (cuts[0], cuts[-1]) for e in (ends_a, ends_b))
    text, _, links = aligned(pair, a[head_a:tail_a], ends_a[head_a:tail_a], b[head_b:tail_b], ends_b[head_b:tail_b], cuts[1:])
    return Fragment(
        len(a), len(b), True, open_a(a[:head_a]), open_b(b[:head_b]), b"".join(text), links.tobytes(), open_a(a[tail_a:]), open_b(b[tail_b:])
    )


def ranges(pair: Pair, a: list[int], b: list[int], start: int, size: int) -> Iterator[tuple[int, Fragment]]:
    """The fragments of byte ranges of a document, of the ids of a piece that begins at byte ``start``; with the ranges' numbers."""
    a, b = np.array(a, "i8"), np.array(b, "i8")
    ends_a, ends_b = (start + np.cumsum(n[i]) for n, i in ((pair.lengths_a, a), (pair.lengths_b, b)))
    if not len(a):
        return
    for number in range(start // size, int(ends_a[-1] - 1) // size + 1):
        (i, j), (k, m) = (np.searchsorted(e, [number * size, (number + 1) * size], "right") for e in (ends_a, ends_b))
        yield number, fragment(pair, a[i:j], ends_a[i:j], b[k:m], ends_b[k:m])


class _Words:
    """Words to their closed groups and links; groups are None for a word that isn't spelled as it is."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.groups: dict[str, bytes | None] = {}
        self.links: dict[str, bytes] = {}
        self.older: tuple[dict, dict] = {}, {}

    def want(self, words: set[str]) -> None:
        """Finds what isn't kept; words that weren't wanted for long are dropped first."""
        if len(self.groups) > CACHED:
            self.older, self.groups, self.links = (self.groups, self.links), {}, {}
        missing = words - self.groups.keys()
        for mine, old in zip((self.groups, self.links), self.older):
            mine.update((w, old[w]) for w in missing & old.keys())
        missing -= self.groups.keys()
        if missing:
            self._learn(list(missing))

    def _learn(self, fresh: list[str]) -> None:
        """Joined words are tokenized as if alone; those that can't be joined, or stand beside one that isn't spelled, follow alone."""
        self.groups.update(dict.fromkeys(fresh))
        joins = [bool(w) and w[-1] != " " and not w[0].isspace() for w in fresh]
        plain, others = ([w for w, x in zip(fresh, joins) if x == side] for side in (True, False))
        for words, size in ((plain, _JOINED), (others, 1)):
            parts = [words[i : i + size] for i in range(0, len(words), size)]
            if not parts:
                continue
            spans = [" ".join(p) for p in parts]
            a, b = self.pair.encode(spans)
            good = self.pair.spelled(spans, a, b)
            if len(good) < len(parts):
                if size > 1:
                    bad = set(range(len(parts))) - set(good)
                    others += [w for i in bad for w in parts[i]]
                parts, a, b = ([x[i] for i in good] for x in (parts, a, b))
            if parts:
                self._keep(list(chain.from_iterable(parts)), a, b)

    def _keep(self, words: list[str], *tokens: list[list[int]]) -> None:
        pair = self.pair
        ids = [np.array(list(chain.from_iterable(x)), "i8") for x in tokens]
        ends = [np.cumsum(n[i]) for n, i in zip((pair.lengths_a, pair.lengths_b), ids)]
        cuts = np.intersect1d(*ends, assume_unique=True)
        text, begin, links = aligned(pair, ids[0], ends[0], ids[1], ends[1], cuts)
        # every word ends at a cut: its groups are those up to it
        last = np.searchsorted(cuts, np.cumsum([1 + len(w.encode()) for w in words])) + 1
        stops = np.append(begin, len(text))[last].tolist()
        self.groups.update(zip(words, [b"".join(text[i:j]) for i, j in zip([0, *stops], stops)]))
        raw, stops = links.tobytes(), (last * links.itemsize).tolist()
        self.links.update(zip(words, [raw[i:j] for i, j in zip([0, *stops], stops)]))

    def document(self, words: list[str]) -> tuple[bytes, bytes] | None:
        """Groups and links of words that were wanted."""
        groups = list(map(self.groups.__getitem__, words))
        if None in groups:
            return None
        return b"".join(groups), b"".join(map(self.links.__getitem__, words))


@lru_cache(1)
def _pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


@lru_cache(1)
def _words(path_a: str, path_b: str) -> _Words:
    """What a Python worker knows of words; it serves one task after the other."""
    return _Words(_pair(path_a, path_b))


def split(text: str) -> list[str]:
    """The words of a text: cut at the spaces that both tokenizers cut it at."""
    return _SPACE.split(text) if _OTHER.search(text) else text.split(" ")


def _document(doc_id, text: bytes, links: bytes) -> tuple:
    n_groups = text.count(b"|")
    digest = sha256(text[:-1].replace(b".", b",")).hexdigest() if text else ""
    return doc_id, text.count(b".") + n_groups, text.count(b",") + n_groups, n_groups, links, digest


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = [pa.field(name, _KINDS[kind]) for name, kind in map(str.split, schema.split(","))]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), kinds)] if rows else [pa.array([], f.type) for f in kinds], schema=pa.schema(kinds))


def _short(path_a: str, path_b: str):
    """Documents of texts that are one row."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, known = _pair(path_a, path_b), _words(path_a, path_b)
        for batch in batches:
            for first in range(0, batch.num_rows, _BATCH):
                some = batch.slice(first, _BATCH)
                ids, spans = some.column("doc_id").to_pylist(), some.column("text").to_pylist()
                cut = [split(s) if s else [] for s in spans]
                known.want(set().union(*cut))
                rows = []
                for doc_id, span, words in zip(ids, spans, cut):
                    found = known.document(words)
                    if found is None:  # by the whole text
                        (a,), (b,) = pair.encode([span])
                        found = b"", b""
                        if pair.spells(span, a, b):
                            x = reduce(lambda x, y: compose((pair.n_b, pair.code), x, y), (f for _, f in ranges(pair, a, b, 0, RANGE)), Fragment())
                            found = whole((pair.n_b, pair.code), x)
                    rows.append(_document(doc_id, *found))
                yield _batch(rows, _DOC)

    return documents


def _pieces(size: int):
    """(uid, doc_id, piece, start, text): long texts cut at words; ``start`` is the byte at which a piece and its space begin."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("uid", "doc_id", "text"))):
                first = start = number = 0
                while True:
                    space = _SPACE.search(text, first + size)
                    part = text[first : space.start()] if space else text[first:]
                    yield _batch([(uid, doc_id, number, start, part)], "uid long, doc_id long, piece int, start long, text string")
                    if not space:
                        break
                    first, start, number = space.end(), start + 1 + len(part.encode()), number + 1

    return cut


def _fragments(path_a: str, path_b: str, size: int):
    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(path_a, path_b)
        for batch in batches:
            for n in range(batch.num_rows):
                uid, doc_id, piece, start, text = (batch.column(c)[n].as_py() for c in ("uid", "doc_id", "piece", "start", "text"))
                (a,), (b,) = pair.encode([text])
                if not pair.spells(text, a, b):
                    yield _batch([(uid, doc_id, start // size, piece, False, *vars(Fragment()).values())], _PART)
                    continue
                for number, x in ranges(pair, a, b, start, size):
                    yield _batch([(uid, doc_id, number, piece, True, *vars(x).values())], _PART)

    return fragments


def _composed(pair_code: tuple[int, str]):
    """Neighbouring fragments of one (uid, range) as one, of rows in order."""

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = held = None
        for batch in batches:
            for n in range(batch.num_rows):
                uid, doc_id, number, piece, ok, *parts = (column[n].as_py() for column in batch.columns)
                if key and key[0] == uid and key[2] == number:
                    key = (*key[:4], key[4] and ok)
                    held = compose(pair_code, held, Fragment(*parts))
                else:
                    if key:
                        yield _batch([(*key, *vars(held).values())], _PART)
                    key, held = (uid, doc_id, number, piece, ok), Fragment(*parts)
        if key:
            yield _batch([(*key, *vars(held).values())], _PART)

    return composed


def _finished(pair_code: tuple[int, str]):
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                _, doc_id, _, _, ok, *parts = (column[n].as_py() for column in batch.columns)
                x = Fragment(*parts) if ok else Fragment()
                yield _batch([_document(doc_id, *whole(pair_code, x))], _DOC)

    return documents


def documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE, size: int = RANGE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, links, groups_sha256) per document, written; ``links`` has a number for each link, as ``Pair.code``."""
    pair = _pair(path_a, path_b)
    pair_code = (pair.n_b, pair.code)
    rows = texts(docs, id_col, text_col)
    long = F.length("text") > piece
    short = rows.filter(~long).mapInArrow(_short(path_a, path_b), _DOC)
    many = rows.withColumn("uid", F.monotonically_increasing_id()).filter(long).select("uid", "doc_id", "text")
    many = many.mapInArrow(_pieces(piece), "uid long, doc_id long, piece int, start long, text string").repartition("uid", "piece")
    finish = _finished(pair_code)
    with setting(docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", str(_BATCH)):
        parts = written(many.mapInArrow(_fragments(path_a, path_b, size), _PART), "align-fragments")
        top = parts.agg(F.max("range")).first()[0]
        level = top + 1 if top is not None else 0
        while level > FAN:
            parts = _by_range(parts).mapInArrow(_composed(pair_code), _PART)
            level = -(-level // FAN)
        if level:  # the last level and the documents in one pass, so that a task needs one Python worker
            compose_last = _composed(pair_code)
            parts = _by_range(parts).mapInArrow(lambda batches: finish(compose_last(batches)), _DOC)
        else:
            parts = parts.mapInArrow(finish, _DOC)
        return written(short.unionByName(parts), "align-documents")


def _by_range(parts: DataFrame) -> DataFrame:
    """The fragments of ``FAN`` neighbouring ranges together and in order, numbered as the range that they make."""
    parts = parts.withColumn("to", F.floor(F.col("range") / FAN)).repartition("uid", "to").sortWithinPartitions("uid", "range", "piece")
    return parts.withColumn("range", F.col("to")).drop("to")


def _counts(code: str):
    """(pair, n) of links, added up in a task."""

    def add(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        pairs, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
        return pairs, np.bincount(at, np.concatenate([n for _, n in held]), len(pairs)).astype("i8")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh, size = [], [], 0
        for batch in batches:
            for links in batch.column("links"):
                fresh.append(np.frombuffer(links.as_buffer(), code))
                size += len(fresh[-1])
                if size >= _COUNTED:
                    held = [add([*held, np.unique(np.concatenate(fresh), return_counts=True)])]
                    fresh, size = [], 0
                    if len(held[0][0]) >= _COUNTED:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0][0].astype("i8")), pa.array(held[0][1])], ["pair", "n"])
                        held = []
        if fresh:
            held = [add([*held, np.unique(np.concatenate(fresh), return_counts=True)])]
        for pairs, n in held:
            yield pa.RecordBatch.from_arrays([pa.array(pairs.astype("i8")), pa.array(n)], ["pair", "n"])

    return counts


def pair_counts(found: DataFrame, n_b: int, code: str) -> DataFrame:
    """(pair, a, b, n, best): how often each id pair is linked, and if no pair with the same b is linked more often."""
    counts = written(found.select("links").mapInArrow(_counts(code), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "align-counts")
    counts = counts.select("pair", F.floor(F.col("pair") / n_b).alias("a"), (F.col("pair") % n_b).alias("b"), "n")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return written(counts.join(most, "b").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best")), "align-pairs")


def _least(counts: DataFrame, limit: int) -> int:
    """The power of two from which on at most ``limit`` pairs are linked as often."""
    sizes = {r["bits"]: r["pairs"] for r in counts.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count("*").alias("pairs")).collect()}
    total, bits = 0, 64
    while bits > 1 and total + sizes.get(bits - 1, 0) <= limit:
        bits -= 1
        total += sizes.get(bits, 0)
    return 1 << (bits - 1)


def _scored(frequent, code: str):
    """Adds up what is known of each document's links; the others are passed on with how often they occur."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = frequent.value
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                some = batch.slice(first, 500)
                lists = [np.frombuffer(x.as_buffer(), code) for x in some.column("links")]
                sizes = np.array(list(map(len, lists)))
                links, at = np.unique(np.concatenate(lists).astype("i8"), return_inverse=True)
                place = np.minimum(np.searchsorted(pairs, links), max(0, len(pairs) - 1))
                known = pairs[place] == links if len(pairs) else np.zeros(len(links), bool)
                count = np.where(known, n[place], 0) if len(pairs) else np.zeros(len(links), "i8")
                good = known & best[place] if len(pairs) else known
                begin = np.concatenate([[0], np.cumsum(sizes)])
                sums, bests = (np.concatenate([[0], np.cumsum(x[at])]) for x in (count, good.astype("i8")))
                missed = []
                for i, j in zip(begin, begin[1:]):
                    mine = at[i:j][~known[at[i:j]]]
                    which, often = np.unique(mine, return_counts=True)
                    missed.append([{"pair": p, "often": c} for p, c in zip(links[which].tolist(), often.tolist())])
                kind = pa.list_(pa.struct([("pair", pa.int64()), ("often", pa.int64())]))
                columns = [some.column(c) for c in ("uid", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(np.diff(bests[begin])), pa.array(np.diff(sums[begin])), pa.array(missed, kind)],
                    ["uid", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_best", "count_sum", "missed"],
                )

    return scored


def alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", limit: int | None = None) -> DataFrame:
    """Per document: n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    ``n_best`` counts the links of a pair that no pair with the same b is linked more often than; ``count_sum`` adds up the
    counts of the links' pairs. ``limit`` stands in for ``FREQUENT``.
    """
    spark, pair = docs.sparkSession, _pair(path_a, path_b)
    found = documents(docs, path_a, path_b, id_col, text_col)
    counts = pair_counts(found, pair.n_b, pair.code)
    least = _least(counts, FREQUENT if limit is None else limit)
    hot = counts.filter(F.col("n") >= least).select("pair", "n", "best").toArrow().sort_by("pair")
    hot = spark.sparkContext.broadcast(tuple(hot.column(c).to_numpy() for c in ("pair", "n", "best")))
    scored = found.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(
        _scored(hot, pair.code),
        "uid long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_best long, count_sum long, missed array<struct<pair:long,often:long>>",
    )
    best, total = F.col("n_best"), F.col("count_sum")
    rare = counts.filter(F.col("n") < least)
    if not rare.isEmpty():
        scored = written(scored, "align-scored")
        missed = scored.select("uid", F.explode("missed").alias("m")).select("uid", "m.*").join(rare, "pair")
        rest = missed.groupBy("uid").agg(
            F.sum(F.when(F.col("best"), F.col("often")).otherwise(0)).alias("more_best"), F.sum(F.col("often") * F.col("n")).alias("more_sum")
        )
        scored = scored.join(rest, "uid", "left")
        best, total = best + F.coalesce("more_best", F.lit(0)), total + F.coalesce("more_sum", F.lit(0))
    return scored.select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), best.alias("n_best"), total.alias("count_sum"), "groups_sha256"
    )
