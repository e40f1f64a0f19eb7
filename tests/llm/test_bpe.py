"""Byte-level BPE against the tiktoken library."""

import random
from urllib.parse import urlparse

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from dirlens.llm import bytebpe
from dirlens.llm.bytebpe import Ranks, decoder, each_document, encode, read_ranks

PATHS = [public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")]
FIRST = PATHS[0]


def library(path):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})


def encoded(df, path=FIRST):
    rows = each_document(encode(df, path), "doc_id long, ids array<int>", lambda doc, ids: {"doc_id": doc, "ids": ids.tolist()})
    return sorted(((r.doc_id, list(r.ids)) for r in rows.collect()), key=str)


@pytest.mark.parametrize("path", PATHS)
def test_folds_equal_the_library(spark, path):
    rng = random.Random(6)
    letters = ("ab", "=", "-= ", "é𝒳ß", "aeiou", "\n ", "the in", "aba", "日本語の")
    words = {w for _ in range(300) for w in regex.findall(public_tokenizers.PATTERN, "".join(rng.choice(rng.choice(letters)) for _ in range(rng.randint(1, 40))))}
    words |= {"=" * 301, "a" * 200, "aba" * 60}
    ranks, check = Ranks(spark, path), library(path)
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", *ranks.constants())
    folded = df.select("w", ranks.fold(F.col("w")).alias("ids"))
    assert [r.w for r in folded.collect() if r.ids != check.encode_ordinary(r.w)] == []
    # the rank map is a constant of the expression, not a column of every row
    assert folded._jdf.queryExecution().optimizedPlan().toString().count("scalar-subquery") == 2


def test_long_words(spark):
    """Words without any space: a merge costs two look-ups, whatever the length."""
    rng = random.Random(3)
    words = ["".join(rng.choice(letters) for _ in range(n)) for letters, n in (
        ("abcdefghijklmnopqrstuvwxyz", 5_000), ("ACGT", 2_000), ("日本語の", 700), ("ab", 258), ("=", 3_000), ("aba", 257), ("0123456789abcdef", 1_000),
    )]
    ranks, check = Ranks(spark, FIRST), library(FIRST)
    pieces = [p for w in words for p in regex.findall(public_tokenizers.PATTERN, w)]
    folded = spark.createDataFrame([(w,) for w in pieces], "w string").repartition(8).select("w", *ranks.constants()).select("w", ranks.fold(F.col("w")).alias("ids"))
    assert [r.w[:20] for r in folded.collect() if r.ids != check.encode_ordinary(r.w)] == [] and max(map(len, pieces)) == 5_000


def test_both_folds_agree(spark, monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choice("aeinrst =é日") for _ in range(rng.randint(1, 30))) for _ in range(200)] + ["a", "aa", "aaa"]
    ranks = Ranks(spark, FIRST)
    both = []
    for short in (256, 1):
        monkeypatch.setattr(bytebpe, "SHORT", short)
        both.append({r.w: r.ids for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", *ranks.constants()).select("w", ranks.fold(F.col("w")).alias("ids")).collect()})
    assert both[0] == both[1]


def test_a_word_that_is_a_token_is_taken_as_it_is(spark, tmp_path):
    import base64

    tokens = [bytes([b]) for b in range(256)] + [b"bc", b"abc", b"xyz"]
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    ranks = Ranks(spark, str(path))
    assert ranks.whole == {"xyz": 258}  # no merges lead there
    words = ["xyz", "abc", "xyza", "bc", "xy"]
    check = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=read_ranks(str(path)), special_tokens={})
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", *ranks.constants()).select("w", ranks.fold(F.col("w")).alias("ids"))
    assert {r.w: r.ids for r in df.collect()} == {w: check.encode_ordinary(w) for w in words}


def test_texts_equal_the_library_and_come_back(docs, odd, none, monkeypatch):
    monkeypatch.setattr(bytebpe, "BLOCK_CHARS", 400)
    check, decode = library(FIRST), decoder(FIRST)
    table = docs(*((i, f"It's word{i % 3} number {i}, isn't it?\n\n  x{'=' * i} é𝒳") for i in range(12)))
    for df in (table, odd):
        expected = sorted(((r.doc_id, check.encode_ordinary(r.text or "")) for r in df.collect()), key=str)
        assert encoded(df) == expected
    back = each_document(encode(odd, FIRST), "doc_id long, text binary", lambda doc, ids: {"doc_id": doc, "text": decode(ids)})
    assert sorted((str(r.doc_id), bytes(r.text).decode()) for r in back.collect()) == sorted((str(r.doc_id), r.text or "") for r in odd.collect())
    assert encoded(none) == []


def test_a_small_dictionary_gives_the_same(docs, monkeypatch):
    table = docs(*((i, "the the the of of and " + f"w{i} " * i) for i in range(6)))
    whole = encoded(table)
    monkeypatch.setattr(bytebpe, "DICTIONARY", 1)
    assert encoded(table) == whole


def test_texts_are_cut_once(docs):
    """The blocks that are read for the result hold numbers of words; the pattern isn't applied to texts again."""
    blocks = encode(docs((1, "some words"), (2, None)), FIRST)
    plan = blocks._jdf.queryExecution().toString()
    assert "regexp_replace" not in plan and "text" not in blocks.columns


def test_a_block_of_many_words(docs):
    """More words than two bytes can number."""
    check, text = library(FIRST), " ".join(map(str, range(66_000)))
    assert encoded(docs((1, "a"), (2, text))) == [(1, check.encode_ordinary("a")), (2, check.encode_ordinary(text))]


@pytest.mark.parametrize("path", PATHS)
def test_words_merged_side_by_side_equal_the_library(path):
    rng = random.Random(12)
    words = ["".join(rng.choice(rng.choice(("aeinrst", "the ing", "=-", "日本語é𝒳", "aba", "ABC012"))) for _ in range(rng.randint(1, 30))) for _ in range(2_000)]
    words += ["=" * 250, "a", "aba" * 60, "\n" * 200]
    ranks = read_ranks(path)
    check = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    raw = [w.encode() for w in words]
    ids, sizes = bytebpe.merged_ids(np.frombuffer(b"".join(raw), "u1"), np.array(list(map(len, raw))), bytebpe.pair_table(ranks))
    ends = np.cumsum(sizes).tolist()
    assert [w for w, a, b in zip(words, [0, *ends], ends) if ids[a:b].tolist() != check.encode_ordinary(w)] == []
    assert [len(x) for x in bytebpe.merged_ids(np.zeros(0, "u1"), np.zeros(0, "i4"), bytebpe.pair_table(ranks))] == [0, 0]


def test_only_long_words_are_left_to_the_fold(docs):
    """Words of one block are in no dictionary; the fold of a row at a time has those of more than SHORT bytes only."""
    table = docs((1, "some words of one block, " + "x" * 300), (2, "others qzvkj"))
    blocks = encode(table, FIRST).collect()
    missing = [ids for b in blocks for ids in b.missing]
    assert missing == [library(FIRST).encode_ordinary(" " + "x" * 300)]


def test_texts_of_tokens_that_no_merges_lead_to(docs, tmp_path):
    import base64

    tokens = [bytes([b]) for b in range(256)] + [b"bc", b"abc", b"xyz"]
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    check = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(str(path)), special_tokens={})
    texts = {1: "xyz", 2: "abc xyz", 3: "xyza\nxyz"}
    assert encoded(docs(*texts.items()), str(path)) == [(i, check.encode_ordinary(t)) for i, t in texts.items()]


def test_rows_need_one_python_worker_a_task(docs):
    """Ids are looked up and rows are made in one pass; the rows are those of the two passes."""
    table = docs((1, "some words, " + "x" * 300), (2, None), (3, "some other words " + "=" * 301))
    row = lambda doc, ids: {"doc_id": doc, "ids": ids.tolist()}
    found = bytebpe.documents(table, FIRST, "doc_id long, ids array<int>", row)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted((r.doc_id, list(r.ids)) for r in found.collect()) == encoded(table) == [(r.doc_id, library(FIRST).encode_ordinary(r.text or "")) for r in table.collect()]


def test_a_reader_holds_a_block_at_a_time(docs, monkeypatch):
    """A row group for each block, and numbers that stay compressed until their block's turn: a task's split has many blocks."""
    monkeypatch.setattr(bytebpe, "BLOCK_CHARS", 400_000)
    rng = random.Random(5)
    table = docs(*((i, " the ".join(str(rng.randrange(60_000)) for _ in range(60_000))) for i in range(4))).coalesce(1)
    blocks, _ = bytebpe._prepared(table, FIRST, public_tokenizers.PATTERN, "doc_id", "text")
    files = [pq.ParquetFile(urlparse(f).path).metadata for f in blocks.inputFiles()]
    groups = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert sum(groups) >= 2 and set(groups) == {1}
    for b in blocks.collect():
        many = sum(b.sizes)
        assert len(b.words) > 30_000 and len(b.numbers) < 2 * many
        assert set(bytebpe._unpacked(pa.py_buffer(bytes(b.numbers)), len(b.words), many).tolist()) == set(range(len(b.words)))


def test_many_documents_of_a_block(docs):
    """Ids are gathered for some documents of a block at a time; empty ones and long words are among them."""
    texts = [None, "", "x" * 300, "a few words here", " \n"]
    table = docs(*((i, texts[i % 5] and f"{texts[i % 5]} {i}") for i in range(3 * bytebpe._GATHERED + 5))).coalesce(1)
    check = library(FIRST)
    assert len(encode(table, FIRST).collect()) == 1
    assert encoded(table) == sorted(((r.doc_id, check.encode_ordinary(r.text or "")) for r in table.collect()), key=str)


def test_words_are_merged_in_portions(monkeypatch):
    """However many words a block has that are in no dictionary."""
    rng = random.Random(4)
    words = ["".join(rng.choice("aeinrst é日bcd") for _ in range(rng.randint(1, 40))) for _ in range(500)]
    pairs, whole, sizes = bytebpe.pair_table(read_ranks(FIRST)), bytebpe.merged_ids, []
    raw = [w.encode() for w in words]
    expected = whole(np.frombuffer(b"".join(raw), "u1"), np.array(list(map(len, raw))), pairs)
    monkeypatch.setattr(bytebpe, "_MERGED", 1_000)
    monkeypatch.setattr(bytebpe, "merged_ids", lambda letters, *rest: (sizes.append(len(letters)), whole(letters, *rest))[1])
    found = bytebpe._merged(pa.array(words), pairs)
    assert all(map(np.array_equal, found, expected)) and max(sizes) < 1_200 and sum(sizes) == sum(map(len, raw))
    assert [len(x) for x in bytebpe._merged(pa.array([], pa.string()), pairs)] == [0, 0]
