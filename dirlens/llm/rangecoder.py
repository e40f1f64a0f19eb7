"""An adaptive context-mixing range coder for token ids.

Ids are coded in blocks of their own: each starts from the same state and has a checksum. The head of a string of blocks has the
ids that occur and their frequencies, which is the order-0 model. Within a block two more models adapt: the id that followed
the previous id (order 1), and the one that followed the two previous ids (order 2), each with a count of how often it was right.
The three are mixed into one distribution,

    P(id) = w2 [id = guess 2] + w1 [id = guess 1] + w0 P0(id)

with weights that are learned in the block for each pair of counts. An id's interval in the cumulated mixture drives a
carry-less range coder with a 64-bit low end and 16-bit words, so nothing is coded twice and every id costs one interval.

Blocks don't depend on each other, so up to ``LANES`` of them are coded side by side, an array operation at a time.
All arithmetic is on integers: every machine reads what another one wrote.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 4096
LANES = 1024
#: Contexts that a block has room for, of either order.
_SLOTS_BITS = 11
_SLOTS = 1 << _SLOTS_BITS
_MAGIC = b"IDB2"
_HEAD = "<4sBxxxQIII"
#: Weights add up to 2 ** 15; they move by 1 / 32 of the way to what would have been right.
_WEIGHT = 15
_RATE = 5
_STATES = 512


def _priors() -> tuple[np.ndarray, np.ndarray]:
    """Weights of both guesses to begin with, by (guesses agree, count of order 2, count of order 1)."""
    state = np.arange(_STATES)
    two, one, same = state >> 4 & 15, state & 15, state >> 8
    right = lambda n: (n << _WEIGHT) // (n + 2)
    w2 = np.where(same == 1, right(np.maximum(two, one)), np.where(two > 0, right(two) * 7 // 8, 0))
    w1 = np.where(same == 1, 0, ((1 << _WEIGHT) - w2) * np.minimum(one, 8) // 24)
    return w2.astype("i8"), w1.astype("i8")


def quantised(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Frequencies of at least 1 that add up to a power of two, and its exponent."""
    bits = max(16, len(counts).bit_length() + 1)
    room = (1 << bits) - len(counts)
    freq = 1 + counts.astype("i8") * room // max(1, int(counts.sum()))
    if len(freq):
        freq[counts.argmax()] += (1 << bits) - freq.sum()
    return freq, bits


class _Mixture:
    """The models of some blocks, one lane each. Ids are numbers of the order-0 model."""

    def __init__(self, lanes: int, freq: np.ndarray, bits: int):
        self.bits = bits
        self.freq, self.below = freq, np.cumsum(freq) - freq
        at = np.arange(lanes)
        self.slots, self.states = at << _SLOTS_BITS, at * _STATES
        self.one, self.two = (np.zeros(lanes << _SLOTS_BITS, "i8") for _ in range(2))  # id << 4 | times it was right
        self.w2, self.w1 = (np.tile(w, lanes) for w in _priors())
        self.last, self.before = np.zeros(lanes, "i8"), np.zeros(lanes, "i8")

    def guess(self, n: int) -> None:
        """Both guesses and the weights for the first n lanes."""
        last, before, slots = self.last[:n], self.before[:n], self.slots[:n]
        self.at1 = (last * 40503 >> 5 & _SLOTS - 1) + slots
        self.at2 = (last * 65599 + before * 30011 >> 4 & _SLOTS - 1) + slots
        self.cell1, self.cell2 = self.one.take(self.at1), self.two.take(self.at2)
        self.guess1, self.guess2 = self.cell1 >> 4, self.cell2 >> 4
        self.times1, self.times2 = self.cell1 & 15, self.cell2 & 15
        self.same = self.guess1 == self.guess2
        self.state = self.states[:n] + (self.times2 << 4) + self.times1 + (self.same * 256)
        self.v2, self.v1 = self.w2.take(self.state), self.w1.take(self.state)
        self.big2, self.big1 = self.v2 << self.bits, self.v1 << self.bits
        self.v0 = (1 << _WEIGHT) - self.v2 - self.v1

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the ids in the mixture."""
        self.good2, self.good1 = self.guess2 == ids, self.guess1 == ids
        start = self.v0 * self.below.take(ids) + self.big2 * (self.guess2 < ids) + self.big1 * (self.guess1 < ids)
        return start, self.v0 * self.freq.take(ids) + self.big2 * self.good2 + self.big1 * self.good1

    def find(self, share: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The ids whose intervals hold the shares; ``number`` is the id at each place of the order-0 model."""
        low = np.where(self.guess1 < self.guess2, self.big1, 0)
        start2 = self.v0 * self.below.take(self.guess2) + low
        start1 = self.v0 * self.below.take(self.guess1) + np.where(self.same | (self.guess1 < self.guess2), 0, self.big2)
        end2 = start2 + self.v0 * self.freq.take(self.guess2) + self.big2 + self.big1 * self.same
        end1 = start1 + self.v0 * self.freq.take(self.guess1) + self.big1 + self.big2 * self.same
        after2, after1 = share >= end2, share >= end1
        place = (share - self.big2 * after2 - self.big1 * after1) // self.v0
        ids = number.take(place, mode="clip")
        ids = np.where((share >= start1) & ~after1, self.guess1, ids)
        return np.where((share >= start2) & ~after2, self.guess2, ids)

    def learn(self, n: int, ids: np.ndarray) -> None:
        """Takes in the ids that ``interval`` was asked for last."""
        good2, good1 = self.good2, self.good1
        self.w2[self.state] = self.v2 + (good2 * (1 << _WEIGHT) - self.v2 >> _RATE)
        self.w1[self.state] = self.v1 + ((good1 > self.same) * (1 << _WEIGHT) - self.v1 >> _RATE)
        first = ids << 4 | 1
        for table, at, cell, times, good in (
            (self.one, self.at1, self.cell1, self.times1, good1), (self.two, self.at2, self.cell2, self.times2, good2),
        ):
            # right: one more, up to 15; wrong: half of it, or the id that came
            table[at] = np.where(good, cell + (times < 15), np.where(times > 1, cell - (times + 1 >> 1), first))
        self.before[:n] = self.last[:n]
        self.last[:n] = ids


class _Coder:
    """The low ends and widths of all lanes."""

    def __init__(self, lanes: int, bits: int):
        self.bits = np.uint64(bits + _WEIGHT)
        self.least = np.uint64(1 << (bits + _WEIGHT + 5))
        self.low = np.zeros(lanes, "u8")
        self.span = np.full(lanes, 0xFFFFFFFFFFFFFFFF, "u8")

    def narrow(self, n: int, start: np.ndarray, size: np.ndarray) -> None:
        step = self.span[:n] >> self.bits
        self.low[:n] += step * start.view("u8")
        self.span[:n] = step * size.view("u8")

    def settled(self, n: int):
        """Lanes that need room, with the word that is final, again and again until none is left."""
        some = np.flatnonzero(self.span[:n] < self.least)
        while len(some):
            low, span = self.low.take(some), self.span.take(some)
            # an interval that crosses the boundary of a word ends there
            crosses = (low ^ (low + span - np.uint64(1))) >> np.uint64(48) != 0
            span = np.where(crosses, (~low + np.uint64(1)) & np.uint64((1 << 48) - 1), span) << np.uint64(16)
            yield some, (low >> np.uint64(48)).astype("u2")
            self.low[some], self.span[some] = low << np.uint64(16), span
            some = some.compress(span < self.least)


def _encode_lanes(blocks: list[np.ndarray], freq: np.ndarray, bits: int) -> list[bytes]:
    """Blocks of falling length."""
    lanes, depth = len(blocks), len(blocks[0])
    sizes = np.array([len(b) for b in blocks])
    grid = np.zeros((depth, lanes), "i8")
    for i, b in enumerate(blocks):
        grid[: len(b), i] = b
    model, coder = _Mixture(lanes, freq, bits), _Coder(lanes, bits)
    width = depth * 3 + 8
    out, used = np.zeros(lanes * width, "<u2"), np.arange(lanes) * width
    for t in range(depth):
        n = int(np.searchsorted(-sizes, -t, "left"))
        ids = grid[t, :n]
        model.guess(n)
        coder.narrow(n, *model.interval(ids))
        for lane, word in coder.settled(n):
            out[used.take(lane)] = word
            used[lane] += 1
        model.learn(n, ids)
    for shift in (48, 32, 16, 0):
        out[used] = (coder.low >> np.uint64(shift)).astype("u2")
        used += 1
    return [out[i * width : end].tobytes() for i, end in enumerate(used.tolist())]


def _decode_lanes(data: list[bytes], sizes: np.ndarray, freq: np.ndarray, bits: int) -> list[np.ndarray]:
    lanes, depth = len(data), int(sizes[0])
    words = np.zeros((lanes, max(map(len, data)) // 2 + 4), "u8")
    for i, d in enumerate(data):
        words[i, : len(d) // 2] = np.frombuffer(d, "<u2")
    code = words[:, 0] << np.uint64(48) | words[:, 1] << np.uint64(32) | words[:, 2] << np.uint64(16) | words[:, 3]
    used, words = np.arange(lanes) * words.shape[1] + 4, words.reshape(-1)
    grid = np.zeros((depth, lanes), "i8")
    number = np.repeat(np.arange(len(freq)), freq)
    model, coder = _Mixture(lanes, freq, bits), _Coder(lanes, bits)
    top = np.uint64((1 << (bits + _WEIGHT)) - 1)
    for t in range(depth):
        n = int(np.searchsorted(-sizes, -t, "left"))
        model.guess(n)
        share = np.minimum((code[:n] - coder.low[:n]) // (coder.span[:n] >> coder.bits), top)
        ids = model.find(share.view("i8"), number)
        coder.narrow(n, *model.interval(ids))
        for lane, _ in coder.settled(n):
            code[lane] = code.take(lane) << np.uint64(16) | words.take(used.take(lane), mode="clip")
            used[lane] += 1
        model.learn(n, ids)
        grid[t, :n] = ids
    return [grid[: sizes[i], i] for i in range(lanes)]


def _numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids that occur, each id's number among them, and how often they occur."""
    if not len(ids) or int(ids.max()) >= 1 << 20:
        return np.unique(ids, return_inverse=True, return_counts=True)
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    number = np.zeros(len(counts), "i8")
    number[symbols] = np.arange(len(symbols))
    return symbols, number[ids], counts[symbols]


def encode(ids: np.ndarray) -> bytes:
    """All ids as one string of bytes: a head, the ids that occur, the blocks' lengths, sizes and checksums, the blocks."""
    ids = np.ascontiguousarray(ids, "<u4")
    if len(ids) and int(ids.max()) >= 1 << 26:
        raise ValueError("ids must be below 2 ** 26")
    symbols, numbers, counts = _numbered(ids)
    freq, bits = quantised(counts)
    raw = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
    blocks = [numbers[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
    data: list[bytes] = []
    for i in range(0, len(blocks), LANES):
        data += _encode_lanes(blocks[i : i + LANES], freq, bits)
    model = zlib.compress(np.diff(symbols, prepend=0).astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 6)
    table = np.array([(len(b), len(d), zlib.crc32(b)) for b, d in zip(raw, data)], "<u4").tobytes()
    return b"".join([struct.pack(_HEAD, _MAGIC, bits, len(ids), len(blocks), len(symbols), len(model)), model, table, *data])


def decode(data: bytes) -> np.ndarray:
    """The ids; raises ValueError where a block doesn't have its checksum."""
    magic, bits, total, count, n_symbols, n_model = struct.unpack_from(_HEAD, data)
    if magic != _MAGIC:
        raise ValueError("not a string of coded ids")
    first = struct.calcsize(_HEAD)
    try:
        model = np.frombuffer(zlib.decompress(data[first : first + n_model]), "<u4").astype("i8")
    except zlib.error as broken:
        raise ValueError("the frequencies are damaged") from broken
    symbols, freq = np.cumsum(model[:n_symbols]), model[n_symbols:]
    table = np.frombuffer(data, "<u4", 3 * count, first + n_model).reshape(-1, 3).astype("i8")
    starts = np.cumsum(np.concatenate([[first + n_model + 12 * count], table[:, 1]]))
    parts: list[np.ndarray] = []
    for i in range(0, count, LANES):
        some = range(i, min(count, i + LANES))
        parts += _decode_lanes([data[starts[j] : starts[j + 1]] for j in some], table[i : i + LANES, 0], freq, bits)
    parts = [symbols[p].astype("<u4") for p in parts]
    for part, (_, _, crc) in zip(parts, table.tolist()):
        if zlib.crc32(part) != crc:
            raise ValueError("a block is damaged")
    ids = np.concatenate(parts) if parts else np.zeros(0, "<u4")
    if len(ids) != total:
        raise ValueError("ids are missing")
    return ids
