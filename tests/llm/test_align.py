"""Alignment of two tokenizers: against a plain version over whole texts, and the monoid's laws."""

from collections import Counter
from functools import reduce
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest

from dirlens.llm import align, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "The quick brown fox, jumps! over 12345 lazy dogs", " leading and  double   spaces \n\n next\tline \n end ", "<|endoftext|> <s> </s> <unk>", "a▁b", "▁",
    "日本語のテキスト und ﬀ ½ é́ ￿ 𝒳𝒳", "x", " ", "don't we'll 'tis", " nbsp  em 　wide \x1c sep \x85 nel", "￾ \u0000 nul", "supercalifragilistic " * 30,
    "a▁b and the rest", "tab\t word \n word", "A" * 100 + " " + "ab" * 50, "1 22 333 4444",
]


@pytest.fixture(scope="module")
def pair():
    return align.Pair(A, B)


def plain(pair, text):
    """(n_a, n_b, groups as text, links) by walking over the tokens of the whole text."""
    if not text:
        return 0, 0, "", []
    a = pair.a.encode(" " + text, add_special_tokens=False).ids
    b = pair.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(pair.bytes_a[i] for i in a) != raw or b"".join(pair.bytes_b[i] for i in b) != raw:
        return 0, 0, "", []
    groups, links, at_a, at_b, i, j, first = [], [], 0, 0, 0, 0, (0, 0)
    while i < len(a) or j < len(b):
        if at_a <= at_b:
            at_a, i = at_a + len(pair.bytes_a[a[i]]), i + 1
        else:
            at_b, j = at_b + len(pair.bytes_b[b[j]]), j + 1
        if at_a == at_b:
            groups.append(",".join(map(str, a[first[0] : i])) + "|" + ",".join(map(str, b[first[1] : j])))
            links.append((a[i - 1], b[j - 1]))
            first = (i, j)
    return len(a), len(b), ";".join(groups), links


def expected(pair, rows):
    found = [(doc_id, plain(pair, text)) for doc_id, text in rows]
    counts = Counter(link for _, (_, _, _, links) in found for link in links)
    most: dict = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return sorted(
        ((doc_id, n_a, n_b, len(links), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
          sha256(groups.encode()).hexdigest() if links else "") for doc_id, (n_a, n_b, groups, links) in found), key=str,
    )


def test_equals_plain_version(docs, odd, pair):
    rows = [*enumerate(TEXTS), (None, TEXTS[0]), (0, TEXTS[0]), (99, None), (98, "")]
    for df in (docs(*rows), odd):
        got = sorted(map(tuple, align.alignment(df, A, B).collect()), key=str)
        assert got == expected(pair, [(r.doc_id, r.text) for r in df.collect()])


def test_pairs_that_are_not_sent_to_all(docs, pair):
    rows = list(enumerate(TEXTS))
    for limit in (0, 20):
        got = sorted(map(tuple, align.alignment(docs(*rows), A, B, limit=limit).collect()), key=str)
        assert got == expected(pair, rows)


def test_long_texts_across_tasks(docs, pair):
    """Pieces and ranges of any size give what whole texts give."""
    rows = [*enumerate(TEXTS), (50, " ".join(TEXTS[:3]) * 40), (51, "ab日本" * 900), (52, "good text " * 200 + "a▁b " + "good text " * 200), (None, "no id " * 300)]
    found = {(r[0], sha256(plain(pair, r[1])[2].encode()).hexdigest() if plain(pair, r[1])[3] else "") for r in rows}
    for piece, size in ((64, 16), (200, 1000), (7, 3)):
        got = align.documents(docs(*rows), A, B, piece=piece, size=size).collect()
        assert {(r.doc_id, r.groups_sha256) for r in got} == found and len(got) == len(rows)
        assert {(r.doc_id, r.n_a, r.n_b) for r in got} == {(i, *plain(pair, t)[:2]) for i, t in rows}


def test_words_are_tokenized_alone(pair):
    for text in [*TEXTS, "a  b", "a \n b", "\n a", "a　 b", "  a   b  "]:
        words = align.split(text)
        assert " ".join(words) == text
        ids = [list(map(list, x)) for x in pair.encode(words)]
        assert [sum(x, []) for x in ids] == [list(x[0]) for x in pair.encode([text])], text


def test_composition_is_associative(pair):
    text = "unbelievable 12345 日本語 tokenization " * 3
    (a,), (b,) = pair.encode([text])
    code = (pair.n_b, pair.code)
    rng = np.random.default_rng(7)
    for size in (1, 2, 3, 5, 1000):
        parts = [f for _, f in align.ranges(pair, a, b, 0, size)]
        flat = reduce(lambda x, y: align.compose(code, x, y), parts)
        assert align.compose(code, align.Fragment(), flat) == flat == align.compose(code, flat, align.Fragment())
        while len(parts) > 1:
            i = int(rng.integers(len(parts) - 1))
            parts[i : i + 2] = [align.compose(code, *parts[i : i + 2])]
        assert parts[0] == flat and flat.tail_a == flat.tail_b == b""
        assert align.whole(code, flat)[0][:-1].decode().replace(".", ",") == plain(pair, text)[2]


def test_registered_query_and_empty_table(spark, tmp_path, docs, none, pair):
    docs(*enumerate(TEXTS)).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.QUERIES["op13_token_alignment"](spark, str(tmp_path))
    assert rows.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, rows.collect()), key=str) == expected(pair, enumerate(TEXTS))
    assert align.alignment(none, A, B).collect() == []


def test_a_task_needs_one_python_worker(spark, docs, monkeypatch):
    """The last composition makes the documents, in batches of few texts."""
    plans, write = {}, align.written

    def seen(df, purpose, *more):
        plans[purpose] = df._jdf.queryExecution().executedPlan().toString().count("MapInArrow"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        return write(df, purpose, *more)

    monkeypatch.setattr(align, "written", seen)
    rows = [(1, "short"), (2, "a longer text " * 20)]
    assert {r.doc_id for r in align.documents(docs(*rows), A, B, piece=100, size=100).collect()} == {1, 2}
    assert plans["align-documents"] == (2, str(align._BATCH))  # texts of one row, and fragments
