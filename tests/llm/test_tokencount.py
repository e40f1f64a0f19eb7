"""Token counts against the library's unigram model and plain dynamic programming."""

import random

import public_tokenizers
import regex
from tokenizers import Tokenizer, models

from dirlens.llm.bytebpe import read_ranks
from dirlens.llm.tokencount import Trie, token_counts, zipf_scores

SCORES = zipf_scores(read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))


def library():
    return Tokenizer(models.Unigram([(k.decode("latin-1"), v) for k, v in SCORES.items()], None, False))


def test_documents_equal_the_library(docs, odd, none):
    model = library()
    table = docs(*((i, f"It's the number {i}, isn't it?\n\n  x{'=' * i} é𝒳 unbelievable") for i in range(9)))
    for df in (table, odd):
        expected = []
        for r in df.collect():
            words = regex.findall(public_tokenizers.PATTERN, r.text or "")
            expected.append((r.doc_id, len(words), sum(len(model.encode(w.encode().decode("latin-1")).ids) for w in words)))
        assert sorted(map(tuple, token_counts(df, SCORES).collect()), key=str) == sorted(expected, key=str)
    assert token_counts(none, SCORES).collect() == []


def test_shared_prefixes_are_scored_once():
    trie = Trie(SCORES)
    trie.counts({"alpha", "alphabet", "alphabetic", "beta"})
    assert trie.scored == len("alphabetic") + len("beta")


def test_unknown_bytes_and_ties():
    trie = Trie({b"a": -1.0, b"b": -1.0, b"ab": -2.0})
    assert trie.counts({"ab", "aab", "xyx", "", "ax"}) == {"ab": 1, "aab": 2, "xyx": 3, "": 0, "ax": 2}


def test_order_does_not_matter():
    rng = random.Random(3)
    words = ["".join(rng.choice("theinr") for _ in range(rng.randint(1, 12))) for _ in range(200)]
    one, other = Trie(SCORES), Trie(SCORES)
    assert {w: one.count(w.encode()) for w in words} == other.counts(set(words))
