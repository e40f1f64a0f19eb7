"""Coded ids come back; files agree with the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dirlens.llm import idfile, rangecoder
from dirlens.session import work_folder

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 50_000), st.integers(0, (1 << 26) - 1)), max_size=300))
def test_ids_come_back(ids):
    assert rangecoder.decode(rangecoder.encode(np.array(ids, "u4"))).tolist() == ids


def test_long_streams(monkeypatch):
    monkeypatch.setattr(rangecoder, "LANES", 5)
    rng = np.random.default_rng(3)
    streams = [rng.integers(0, 49_408, 30_000), np.full(25_000, 49_407), np.arange(22_000) % 300, rng.zipf(1.3, 30_000) % 49_408]
    for ids in streams:
        data = rangecoder.encode(ids)
        assert (rangecoder.decode(data) == ids).all()
    # what repeats is predicted: a fraction of a bit each
    assert len(rangecoder.encode(streams[1])) * 8 < 0.5 * len(streams[1])


def test_too_large_ids():
    with pytest.raises(ValueError):
        rangecoder.encode(np.array([1 << 26], "u4"))


def test_blocks_are_checked():
    ids = np.random.default_rng(1).integers(0, 49_408, 5_000).astype("u4")
    data = bytearray(rangecoder.encode(ids))
    data[-900] ^= 4
    with pytest.raises(ValueError):
        rangecoder.decode(bytes(data))
    with pytest.raises(ValueError):
        rangecoder.decode(b"XXXX" + bytes(data[4:]))


def test_blocks_stand_alone():
    """Beside the frequencies in the head, a block's bytes follow from its ids alone."""
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 900, 3 * rangecoder.BLOCK).astype("u4")
    other = ids.copy()
    rng.shuffle(other[rangecoder.BLOCK : 2 * rangecoder.BLOCK])
    x, y = (rangecoder.encode(i) for i in (ids, other))
    assert x != y and x[-4000:] == y[-4000:]


def prose(n):
    """Ids of words that follow each other by habit, with the frequencies of a language."""
    rng = np.random.default_rng(4)
    often = rng.permutation(49_000)[np.minimum(rng.zipf(1.5, n) - 1, 48_999)].astype("u4")
    habit = rng.permutation(49_000).astype("u4")
    follows = rng.random(n) < 0.7
    for i in np.flatnonzero(follows[1:]) + 1:
        often[i] = habit[often[i - 1]]
    return often


def test_fewer_bits_than_zlib_and_than_order_0():
    ids = prose(60_000)
    bits = len(rangecoder.encode(ids)) * 8 / len(ids)
    plain = sum(len(zlib.compress(ids[i : i + rangecoder.BLOCK].tobytes(), 9)) for i in range(0, len(ids), rangecoder.BLOCK)) * 8 / len(ids)
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    assert bits < 0.8 * plain and bits < -(share * np.log2(share)).sum()


def test_frequencies_add_up():
    for counts in (np.array([1]), np.array([10**12, 1, 1]), np.ones(40_000, "i8"), np.ones(70_000, "i8"), np.zeros(0, "i8")):
        freq, bits = rangecoder.quantised(counts)
        assert len(freq) == 0 or (freq.min() >= 1 and freq.sum() == 1 << bits)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="aB1'!$ \té\u0301İ¿日\u2028 s", max_size=30), min_size=1, max_size=8))
def test_joined_words_equal_the_library(texts):
    encoder, library = idfile.Encoder(PATH), Tokenizer.from_file(PATH)
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def files(spark, df, parts=3):
    path = f"{work_folder(spark, 'test-ids')}/ids"
    idfile.write(df, path, PATH, 2, parts)
    rows = idfile.read(spark, path, "doc_id long, start long, n long, crc long", lambda d, s, ids: {"doc_id": d, "start": s, "n": len(ids), "crc": zlib.crc32(ids)})
    return sorted(map(tuple, rows.collect()), key=lambda r: r[1])


def expected(rows):
    library, start, out = Tokenizer.from_file(PATH), 0, []
    for doc, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    return out


def test_files_equal_the_library(spark, docs, odd, none, monkeypatch):
    monkeypatch.setattr(idfile, "FRAME_IDS", 60)
    rows = [(i, t) for i, t in enumerate(["Hello, World's  end", "", None, "a<|endoftext|>b <|startoftext|>", "İstanbul É é", "x\x1cy\x85z", "¿qué? 12345"] * 4)]
    assert files(spark, docs(*reversed(rows))) == expected(rows)
    given = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert files(spark, odd) == expected(given)
    assert files(spark, none) == []
