"""Texts as files of token ids, in the order of document ids, and back.

A file has frames of whole documents. A frame is one string of bytes: its head, the documents' ids and lengths, and
all token ids behind each other as ``rangecoder`` codes them. The files are Parquet, written by Spark, so that a
repeated task leaves one result; a row has a frame, the part it belongs to and the number of ids before it in the part.

Texts are sorted by document id by one range shuffle; encoding happens after it, within a part.

Defined results: a null text is empty and has the end id only; documents with a null id come first; rows that share an id
stay rows of their own, next to each other in no given order; other columns are not looked at; without documents there are
no frames.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dirlens.llm import rangecoder
from dirlens.llm.common import texts

#: A frame ends with the document that brings it to so many ids: one full set of blocks that are coded side by side.
FRAME_IDS = rangecoder.LANES * rangecoder.BLOCK
#: A task keeps the ids of twice as many words.
CACHED = 200_000
#: New words that are tokenized at a time.
_JOINED = 256
#: How the vocabulary marks the end of a word; its other characters stand for a byte each.
_WORD_END = "</w>"
_HEAD = "<4sQ"
_MAGIC = b"IDF1"
_SCHEMA = "part int, frame int, before long, n_docs long, n_ids long, data binary"


class Encoder:
    """The tokenizers library over whole texts, by words where the tokenizer drops white space.

    Such a tokenizer gives a text the ids of its words, one after the other, so a word that was met before needs no second
    run. New words of ASCII letters and marks are joined for one run: each of their characters is part of an id, which says
    where a word's ids end. A text with a special token's string goes to the library as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        self.library = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        vocabulary = self.library.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, "i8")
        for entry, i in vocabulary.items():
            self.sizes[i] = len(entry.removesuffix(_WORD_END))

    def _ids(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, fresh: list[bytes]) -> None:
        plain, others = ([w for w in fresh if w.isascii() == side] for side in (True, False))
        runs = [plain[i : i + _JOINED] for i in range(0, len(plain), _JOINED)]
        for words, ids in zip(runs, self._ids([b" ".join(r).decode() for r in runs])):
            ids = np.array(ids, "<u4")
            ends = np.cumsum(self.sizes[ids])
            till = np.cumsum(list(map(len, words)))
            at = np.searchsorted(ends, till) + 1
            if len(ends) and ends[-1] == till[-1] and np.array_equal(ends[at - 1], till):
                raw, stops = ids.tobytes(), (4 * at).tolist()
                self.known.update(zip(words, [raw[i:j] for i, j in zip([0, *stops], stops)]))
            else:  # the tokenizer isn't one of whole characters
                others += words
        self.known.update(zip(others, [np.array(x, "<u4").tobytes() for x in self._ids([w.decode() for w in others])]))

    def encode(self, batch: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        raw = [t.encode() for t in batch]
        whole = [any(s in t for s in self.special) for t in raw]
        split = [[] if w else t.split() for t, w in zip(raw, whole)]
        if len(self.known) > CACHED:  # words that weren't met for long are dropped first
            self.older, self.known = self.known, {}
        missing = set().union(*split) - self.known.keys()
        self.known.update((w, self.older[w]) for w in missing & self.older.keys())
        missing -= self.known.keys()
        if missing:
            self._learn(list(missing))
        find = self.known.__getitem__
        return [np.array(self._ids([t])[0], "<u4").tobytes() if w else b"".join(map(find, words)) for t, w, words in zip(batch, whole, split)]


def pack(doc_ids: list, ids: list[bytes]) -> bytes:
    """A frame of documents, with little-endian ids each."""
    null = np.array([d is None for d in doc_ids], "u1")
    table = [null.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([len(x) // 4 for x in ids], "<u8").tobytes()]
    return b"".join([struct.pack(_HEAD, _MAGIC, len(doc_ids)), *table, rangecoder.encode(np.frombuffer(b"".join(ids), "<u4"))])


def unpack(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, how many ids each has, and all ids."""
    magic, n = struct.unpack_from(_HEAD, data)
    if magic != _MAGIC:
        raise ValueError("not a frame of documents")
    at = struct.calcsize(_HEAD)
    null = np.frombuffer(data, "u1", n, at)
    docs = np.frombuffer(data, "<i8", n, at + n)
    sizes = np.frombuffer(data, "<u8", n, at + 9 * n).astype("i8")
    return [None if x else int(d) for x, d in zip(null, docs)], sizes, rangecoder.decode(data[at + 17 * n :])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, parts: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all texts to a new folder, in ``parts`` parts of ascending document ids."""
    end = struct.pack("<I", end_id)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder(tokenizer), TaskContext.get().partitionId()
        number = before = size = 0
        held_docs, held = [], []

        def frame() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([x], kind) for x, kind in (
                    (part, pa.int32()), (number, pa.int32()), (before, pa.int64()), (len(held), pa.int64()), (size, pa.int64()), (pack(held_docs, held), pa.binary()),
                )], ["part", "frame", "before", "n_docs", "n_ids", "data"],
            )

        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                some = batch.slice(first, 500)
                for doc, ids in zip(some.column(0).to_pylist(), encoder.encode(some.column(1).to_pylist())):
                    held_docs.append(doc)
                    held.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= FRAME_IDS:
                        yield frame()
                        number, before, size, held_docs, held = number + 1, before + size, 0, [], []
        if held:
            yield frame()

    ordered = texts(docs, id_col, text_col).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(frames, _SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str, schema: str, row) -> DataFrame:
    """A row per document of the files: ``row(doc_id, start, ids)``, with ``start`` the number of ids of all documents before it."""
    frames = spark.read.schema(_SCHEMA).parquet(path)
    ends = sorted((r["part"], r["n"]) for r in frames.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    starts, total = {}, 0
    for part, n in ends:
        starts[part] = total
        total += n

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, data in zip(*(batch.column(c).to_pylist() for c in ("part", "before", "data"))):
                docs, sizes, ids = unpack(data)
                cuts = np.concatenate([[0], np.cumsum(sizes)])
                first = starts[part] + before
                rows = [row(doc, first + int(a), ids[a:b]) for doc, a, b in zip(docs, cuts, cuts[1:])]
                yield pa.RecordBatch.from_pydict({name: [r[name] for r in rows] for name in rows[0]})

    return frames.mapInArrow(documents, schema)
