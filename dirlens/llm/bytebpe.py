"""Byte-level BPE: encoding by ranks and decoding.

A text is cut by the tokenizer's pattern. The merges of a word are a fold of higher-order functions over its bytes: each
step looks up the rank of every neighbouring pair in a constant rank map, takes the lowest and merges it wherever it
occurs, from the left. An id is its rank; within the fold it is one character, so that a word in any state is a string. A word of
more than ``SHORT`` bytes is folded over arrays instead: the state keeps the ranks of its pairs, a step merges one pair and looks up only the
two that this makes anew.

Distinct words are folded, not occurrences. Texts are cut once, into blocks that are written: the distinct words of a few
texts, and the texts as numbers of these. The ``DICTIONARY`` words of most blocks are folded once and sent to all tasks, as one
string array and one array of ids. A block's other words are merged side by side as arrays (``merged_ids``), those of more than
``SHORT`` bytes by the fold, before the block goes to Python. All that is done per occurrence is one gather by number. So no text is shuffled, the dictionary has a
fixed bound, and no word is left out.

Decoding concatenates the bytes of the ids.

Defined results: a null text is empty and has no ids; a null id stays null; repeated rows are encoded each; other columns
are not looked at. The ranks must contain all single bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from dirlens.llm import pretokens
from dirlens.llm.common import setting, texts, written

#: The dictionary's most words, and the longest word (in code points) that it may hold.
DICTIONARY = 500_000
_LONGEST = 40
#: Bytes of the longest word whose pairs are all looked up in every step.
SHORT = 256
#: A block ends with the text that brings it to so many bytes, at four a word.
BLOCK_CHARS = 2 << 20
#: Texts that a task is sent at a time.
_BATCH = "1000"
#: Documents of a block whose ids are gathered at a time, and bytes of its own words that are merged at a time.
_GATHERED = 64
_MERGED = 1 << 18
#: A row group for each block: a reader holds one of them at a time, not all that its split has.
_BLOCK_GROUPS = {"parquet.block.size": str(256 << 10), "parquet.page.size.row.check.min": "1"}
_BUCKETS = 1 << 16
_SEED = 42
#: No id: above all ids.
_NONE = 1 << 31
_ENCODED = "doc_ids array<long>, sizes array<long>, numbers binary, found binary, lengths binary, missing array<array<int>>"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def letter(token: int) -> str:
    """One character for each id, in the order of ids."""
    return chr(token + 1 if token + 1 < 0xD800 else token + 0x801)


def pairs_of(ranks: dict[bytes, int]) -> Iterator[tuple[int, int, int]]:
    """Pairs of ids that may merge, and the joined id."""
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            if token[:i] in ranks and token[i:] in ranks:
                yield ranks[token[:i]], ranks[token[i:]], rank


def rank_map(ranks: dict[bytes, int]) -> tuple[list[dict[str, str]], list[str]]:
    """Pairs of ids that may merge -> the joined id, all as letters, in buckets by hash; and the ids of ``_one_by_one``."""
    buckets: list[dict[str, str]] = [{} for _ in range(_BUCKETS)]
    for left, right, joined in pairs_of(ranks):
        pair = letter(left) + letter(right)
        buckets[xxhash.xxh64_intdigest(pair.encode(), _SEED) % _BUCKETS][pair] = letter(joined)
    return buckets, [letter(rank) for token, rank in ranks.items() if _one_by_one(token, ranks)]


def pair_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted pairs of ids that may merge, each as one number, the joined ids, and the id of each byte."""
    found = np.array([*pairs_of(ranks), (_NONE - 1, _NONE - 1, _NONE)], "i8")
    keys = found[:, 0] << 31 | found[:, 1]
    order = np.argsort(keys)
    return keys[order], found[order, 2], np.array([ranks[bytes([b])] for b in range(256)], "i8")


def _one_by_one(token: bytes, ranks: dict[bytes, int]) -> bool:
    """Two different pairs that overlap make this token, so that merging one of them everywhere at once may differ."""
    cuts = {i for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks}
    return any(token[i:] == token[: len(token) - i] and token[:i] != token[len(token) - i :] for i in cuts if len(token) - i in cuts)


def merged(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The pieces that merges leave, in plain Python."""
    pieces = [word[i : i + 1] for i in range(len(word))]
    while True:
        found = [ranks.get(x + y) for x, y in zip(pieces, pieces[1:])]
        best = min((r for r in found if r is not None), default=None)
        if best is None:
            return pieces
        at = found.index(best)
        pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]


def unreached(ranks: dict[bytes, int]) -> dict[str, int]:
    """Tokens that no merges lead to, if a word can be one: such a word is taken as it is, as every word that is a token."""
    found = {}
    for token, rank in ranks.items():
        if len(token) > 1 and len(merged(token, ranks)) > 1:
            try:
                found[token.decode()] = rank
            except UnicodeDecodeError:
                pass  # no word of a text
    return found


class Ranks:
    """The ranks on the driver and as columns of constants."""

    def __init__(self, spark: SparkSession, path: str):
        self.ranks = read_ranks(path)
        self.whole = unreached(self.ranks)
        buckets, self.careful = rank_map(self.ranks)
        self.table = written(spark.createDataFrame([(buckets,)], "ranks array<map<string,string>>"), "bpe-ranks")

    def constants(self) -> list[Column]:
        """The rank map as the columns ``ranks`` and ``ranks_of_long``: scalar subqueries that the optimizer puts in place of the columns.

        It does so for a column that is named once; one that is named more often would be copied for every row.
        """
        ranks = self.table.select("ranks").scalar()
        return [ranks.alias("ranks"), ranks.alias("ranks_of_long")]

    def fold(self, word: Column) -> Column:
        """The ids of a word, folded over the array of its bytes. Uses the columns ``ranks`` and ``ranks_of_long``."""
        single = "".join(letter(self.ranks[bytes([b])]) for b in range(256))
        begin = F.translate(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), bytes(range(256)).decode("latin-1"), single)
        size = F.octet_length(word)
        whole = F.when(size <= SHORT, self._all_pairs(begin, size)).otherwise(
            let(F.col("ranks_of_long"), lambda ranks: _kept_pairs(begin, size, ranks))
        )
        ids = F.transform(F.filter(F.split(whole, ""), lambda c: c != ""), lambda c: F.ascii(c))
        ids = F.transform(ids, lambda c: F.when(c < 0xD800, c - 1).otherwise(c - 0x801))
        for token, rank in self.whole.items():
            ids = F.when(word == token, F.array(F.lit(rank))).otherwise(ids)
        return ids

    def _all_pairs(self, begin: Column, size: Column) -> Column:
        """The ids of a short word, as letters."""
        start = F.struct(begin.alias("ids"), F.lit(False).alias("done"))
        steps = F.sequence(F.lit(1), F.greatest(size, F.lit(1)))
        return F.aggregate(steps, start, lambda state, _: F.when(state["done"], state).otherwise(self._step(state["ids"])), lambda s: s["ids"])

    def _step(self, ids: Column) -> Column:
        """The pair of the lowest rank, the first such one, merged wherever it occurs, from the left."""
        pair = lambda i: F.substring(ids, i, F.lit(2))
        rank = lambda p: _rank(p, F.col("ranks"))

        def merge(found: Column, best: Column) -> Column:
            at = F.array_position(found, best).cast("int")
            everywhere = F.replace(ids, pair(at), best)
            if self.careful:
                once = F.concat(F.substring(ids, F.lit(1), at - 1), best, F.substring(ids, at + 2, F.length(ids)))
                everywhere = F.when(best.isin(*self.careful), once).otherwise(everywhere)
            return F.struct(everywhere.alias("ids"), F.lit(False).alias("done"))

        end = F.struct(ids.alias("ids"), F.lit(True).alias("done"))
        places = F.sequence(F.lit(1), F.length(ids) - 1)
        merged = let(F.transform(F.transform(places, pair), rank), lambda found: let(
            F.array_min(found), lambda best: F.when(best.isNull(), end).otherwise(merge(found, best))
        ))
        return F.when(F.length(ids) < 2, end).otherwise(merged)


def _rank(pair: Column, table: Column) -> Column:
    """What a pair of ids merges to, or null."""
    return F.get(table, F.pmod(F.xxhash64(pair), F.lit(_BUCKETS)).cast("int"))[pair]


def _kept_pairs(begin: Column, size: Column, table: Column) -> Column:
    """The ids of a word, as letters, by a state that has its ids, what each pair of neighbours merges to, and the lowest of these."""
    none = F.array().cast("array<string>")

    def state(ids: Column, ranks: Column) -> Column:
        return F.struct(ids.alias("ids"), ranks.alias("ranks"), F.array_min(ranks).alias("best"))

    def step(now: Column) -> Column:
        ids, ranks, best = now["ids"], now["ranks"], now["best"]

        def merge(at: Column) -> Column:
            left = F.when(at > 1, F.array(_rank(F.concat(F.get(ids, at - 2), best), table))).otherwise(none)
            right = F.when(at < F.size(ranks), F.array(_rank(F.concat(best, F.get(ids, at + 1)), table))).otherwise(none)
            joined = F.concat(F.slice(ids, 1, at - 1), F.array(best), F.slice(ids, at + 2, F.size(ids)))
            return let(F.concat(F.slice(ranks, 1, F.greatest(at - 2, F.lit(0))), left, right, F.slice(ranks, at + 2, F.size(ids))), lambda r: state(joined, r))

        return let(F.array_position(ranks, best).cast("int"), merge)

    letters = F.filter(F.split(begin, ""), lambda c: c != "")
    pairs = lambda ids: F.transform(F.sequence(F.lit(0), F.size(ids) - 2), lambda i: _rank(F.concat(F.get(ids, i), F.get(ids, i + 1)), table))
    first = let(letters, lambda ids: let(pairs(ids), lambda ranks: state(ids, ranks)))
    steps = F.sequence(F.lit(1), size)
    return F.aggregate(steps, first, lambda now, _: F.when(now["best"].isNull(), now).otherwise(step(now)), lambda s: F.array_join(s["ids"], ""))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _width(words: int) -> str:
    """The type of the numbers of so many words."""
    return "<u2" if words <= 1 << 16 else "<u4"


def _unpacked(numbers: pa.Buffer, words: int, many: int) -> np.ndarray:
    """The numbers of a block's words, of which it has so many."""
    kind = np.dtype(_width(words))
    return np.frombuffer(pa.Codec("zstd").decompress(numbers, many * kind.itemsize), kind)


def numbered(cut: DataFrame, pattern: str) -> DataFrame:
    """Blocks of texts: (doc_ids, sizes, words, numbers), with ``sizes`` numbers of words for each text.

    A number takes two bytes in a block of few words, else four. The numbers are compressed until the ids of their block are
    gathered (``_unpacked``): a task gets all its blocks at once, and both the JVM and Python hold them meanwhile.
    """

    def block(docs: list, sizes: list[int], numbers: list[int], words: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([docs], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([list(words)], pa.list_(pa.string())),
            pa.array([pa.Codec("zstd", 3).compress(np.array(numbers, _width(len(words))).tobytes(), asbytes=True)], pa.binary()),
        ], ["doc_ids", "sizes", "words", "numbers"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, sizes, numbers, known, following = [], [], [], {}, count()
        for batch in batches:
            for doc, words in zip(batch.column("doc_id").to_pylist(), pretokens.words(batch, pattern)):
                known.update(zip(set(words).difference(known), following))
                numbers += map(known.__getitem__, words)
                sizes.append(len(words))
                docs.append(doc)
                if 4 * len(numbers) >= BLOCK_CHARS:
                    yield block(docs, sizes, numbers, known)
                    docs, sizes, numbers, known, following = [], [], [], {}, count()
        if docs:
            yield block(docs, sizes, numbers, known)

    return cut.mapInArrow(number, "doc_ids array<long>, sizes array<long>, words array<string>, numbers binary")


def word_counts(blocks: DataFrame) -> DataFrame:
    """(w, n): how many blocks have each word of at most ``_LONGEST`` code points."""
    words = blocks.select(F.explode("words").alias("w")).filter(F.char_length("w") <= _LONGEST)
    return words.groupBy("w").agg(F.count("*").alias("n"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """All words from some count on, at most ``most`` of them; a word of one block is left to it."""
    sizes = counts.filter("n > 1").groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.count("*").alias("words"))
    total, least = 0, None
    for row in sorted(sizes.collect(), key=lambda r: -r["n"]):
        total += row["words"]
        if total > most:
            break
        least = row["n"]
    return counts.filter(F.col("n") >= least) if least is not None else counts.limit(0)


def _sliced(starts: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """All slices of the values behind each other."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def merged_ids(letters: np.ndarray, sizes: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some words out of their bytes, behind each other, and how many each word has.

    A step merges the first pair of the lowest rank in each word that has one, and looks up only the two pairs that this makes anew.
    """
    keys, joined, single = pairs

    def rank(left: np.ndarray) -> np.ndarray:
        """What the ids at some places merge to with the next ones; ``_NONE`` at the end of a word."""
        right = np.minimum(left + 1, len(ids) - 1)
        pair = ids[left] << 31 | ids[right]
        at = np.searchsorted(keys, pair)
        return np.where((keys[at] == pair) & (word[left] == word[right]) & (left < right), joined[at], _NONE)

    ids, word = single[letters], np.repeat(np.arange(len(sizes)), sizes)
    ranks, whole = rank(np.arange(len(ids))), []
    while len(ids):
        best = np.minimum.reduceat(ranks, np.cumsum(sizes) - sizes)
        least = np.repeat(best, sizes)
        going = least < _NONE
        whole.append((word[~going], ids[~going]))
        at = np.flatnonzero(going & (ranks == least))
        at = at[np.diff(word[at], prepend=-1) > 0]
        ids[at] = ranks[at]
        kept = going.copy()
        kept[at + 1] = False
        ids, word, ranks, at = ids[kept], word[kept], ranks[kept], np.cumsum(kept)[at] - 1
        sizes = sizes[best < _NONE] - 1
        ranks[at] = rank(at)
        before = at[at > 0] - 1
        ranks[before] = rank(before)
    word, ids = (np.concatenate(x) if x else np.zeros(0, "i8") for x in zip(*whole)) if whole else (word, ids)
    return ids[np.argsort(word, kind="stable")].astype("<i4"), np.bincount(word)


def _merged(words: pa.Array, pairs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``merged_ids`` of some words, a portion at a time, whatever their number."""
    sizes = pc.binary_length(words).to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes, dtype="i8") // _MERGED)) + 1).tolist(), len(words)]
    parts = []
    for a, b in zip(cuts, cuts[1:]):
        letters = "".join(words.slice(a, b - a).to_pylist()).encode()
        parts.append(merged_ids(np.frombuffer(letters, "u1"), sizes[a:b], pairs))
    ids, many = zip(*parts)
    return np.concatenate(ids), np.concatenate(many)


def _look_up(known):
    """Blocks with (found, lengths): the ids of all words of at most ``SHORT`` bytes, and how many each word has, -1 for the others."""

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, starts, sizes, ids, pairs = known.value
        for batch in batches:
            lists = batch.column("words")
            every = pc.index_in(lists.flatten(), value_set=entries).fill_null(-1).to_numpy()
            ends = np.cumsum([0, *lists.value_lengths().to_pylist()])
            for n in range(batch.num_rows):
                words, at = lists[n].values, every[ends[n] : ends[n + 1]]
                late = pc.binary_length(words).to_numpy() > SHORT
                hit, own = (at >= 0) & ~late, (at < 0) & ~late
                merged, many = _merged(words.filter(pa.array(own)), pairs)
                first, lengths = np.zeros(len(at), "i8"), np.full(len(at), -1, "<i4")
                first[hit], lengths[hit] = starts[at[hit]], sizes[at[hit]]
                first[own], lengths[own] = len(ids) + np.cumsum(many) - many, many
                found = _sliced(first[~late], lengths[~late], np.concatenate([ids, merged]))
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).slice(n, 1) for c in ("doc_ids", "sizes", "numbers")), pa.array([found.tobytes()], pa.binary()),
                    pa.array([lengths.tobytes()], pa.binary()), batch.column("missing").slice(n, 1),
                ], ["doc_ids", "sizes", "numbers", "found", "lengths", "missing"])

    return look_up


def _prepared(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str):
    """Blocks of numbered words with the ids of those above ``SHORT`` bytes as ``missing``, and what ``_look_up`` needs for the others."""
    spark = docs.sparkSession
    ranks = Ranks(spark, path)
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", _BATCH):
        blocks = written(numbered(pretokens.cut(texts(docs, id_col, text_col), pattern), pattern), "bpe-blocks", "zstd", _BLOCK_GROUPS)
    counts = written(word_counts(blocks), "bpe-counts")
    words = frequent(counts, DICTIONARY).select("w", *ranks.constants()).select("w", ranks.fold(F.col("w")).alias("ids"))
    folded = written(words, "bpe-words").toArrow().combine_chunks()
    entries, lists = (pa.concat_arrays(folded.column(c).chunks) if folded.num_rows else pa.array([], kind) for c, kind in (("w", pa.string()), ("ids", pa.list_(pa.int32()))))
    # tokens that no merges lead to are taken as they are, in every block
    entries = pa.concat_arrays([entries, pa.array(ranks.whole, pa.string())])
    sizes = np.concatenate([lists.value_lengths().to_numpy(), np.ones(len(ranks.whole), "i4")])
    ids = np.concatenate([lists.flatten().to_numpy(), list(ranks.whole.values())]).astype("<i4")
    known = spark.sparkContext.broadcast((entries, np.cumsum(sizes) - sizes, sizes, ids, pair_table(ranks.ranks)))
    late = F.filter("words", lambda w: F.octet_length(w) > SHORT)
    return blocks.select("*", *ranks.constants()).select(*blocks.columns, F.transform(late, ranks.fold).alias("missing")), known


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_ids, sizes, numbers, found, lengths, missing): blocks of documents for ``each_document``.

    ``numbers`` has a word's number for each word of the documents, compressed; ``sizes`` of them each. ``lengths`` says how many ids a word has, or -1
    for the next one in ``missing``, which are arrays of ids; the ids of the others are in ``found``, as little-endian 32-bit integers.
    """
    blocks, known = _prepared(docs, path, pattern, id_col, text_col)
    return blocks.mapInArrow(_look_up(known), _ENCODED)


def _block_ids(numbers: pa.Buffer, sizes: np.ndarray, found: np.ndarray, lengths: np.ndarray, missing: pa.ListArray) -> Iterator[np.ndarray]:
    """The ids of each document of a block, gathered for some documents at a time."""
    own = missing.value_lengths().to_numpy()
    ids = np.concatenate([found, missing.flatten().to_numpy().astype("<i4")])
    late, many = lengths < 0, lengths.astype("i8")
    many[late] = own
    starts = np.empty_like(many)
    starts[~late] = np.cumsum(many[~late]) - many[~late]
    starts[late] = len(found) + np.cumsum(own) - own
    words = np.cumsum([0, *sizes])
    every = _unpacked(numbers, len(lengths), int(words[-1]))
    for i in range(0, len(sizes), _GATHERED):
        cuts = words[i : i + _GATHERED + 1]
        at = every[cuts[0] : cuts[-1]]
        some = _sliced(starts[at], many[at], ids)
        ends = np.concatenate([[0], np.cumsum(many[at])])[cuts - cuts[0]].tolist()
        yield from (some[a:b] for a, b in zip(ends, ends[1:]))


def _rows(schema: str, row):
    pa_schema = to_arrow_schema(StructType.fromDDL(schema))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                found, lengths = (np.frombuffer(batch.column(c)[n].as_buffer(), "<i4") for c in ("found", "lengths"))
                sizes = batch.column("sizes")[n].values.to_numpy()
                ids = _block_ids(batch.column("numbers")[n].as_buffer(), sizes, found, lengths, batch.column("missing")[n].values)
                out = list(map(row, batch.column("doc_ids")[n].as_py(), ids))
                yield pa.RecordBatch.from_pylist(out, pa_schema)

    return rows


def each_document(blocks: DataFrame, schema: str, row) -> DataFrame:
    """A row per document of the blocks: ``row(doc_id, ids)`` gives its values in the order of the schema."""
    return blocks.mapInArrow(_rows(schema, row), schema)


def documents(docs: DataFrame, path: str, schema: str, row, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``each_document`` of ``encode``, in one pass: a task needs one Python worker, not one for the ids and one for the rows."""
    blocks, known = _prepared(docs, path, pattern, id_col, text_col)
    look_up, rows = _look_up(known), _rows(schema, row)
    return blocks.mapInArrow(lambda batches: rows(look_up(batches)), schema)


def decoder(path: str):
    """A function from ids to the bytes they stand for."""
    ranks = read_ranks(path)
    pieces = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    return lambda ids: b"".join(map(pieces.__getitem__, ids.tolist()))
