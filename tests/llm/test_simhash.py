"""SimHash groups against all pairs."""

import random
import re

import pytest
import xxhash

from dirlens.llm import simhash
from dirlens.llm.simhash import allocate, correlated_parts, linked, near_duplicates, one_of_each


def fingerprint(text, length):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + length]) for i in range(len(words) - length + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest(prints, most):
    """The least reachable index of each fingerprint."""
    root = list(range(len(prints)))
    for _ in prints:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= most:
                    root[i] = root[j] = min(root[i], root[j])
    return root


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_and_groups(docs, odd):
    rng = random.Random(2)
    base = [" ".join(rng.choice(("ab", "Cd", "ef", "gh", "é")) + str(rng.randrange(40)) for _ in range(60)) for _ in range(6)]
    rows = [(i, base[i % 6] if i % 3 else " ".join(base[i % 6].split()[:58])) for i in range(24)] + [(50, "two words"), (51, "Two\twords"), (52, " "), (53, "")]
    for df in (docs(*rows), odd):
        given = [(r.doc_id, r.text) for r in df.collect()]
        prints = [fingerprint(t, 4) for _, t in given]
        roots = smallest(prints, 4)
        least = {r: min((d for (d, _), q in zip(given, roots) if q == r and d is not None), default=None) for r in roots}
        expected = [(d, signed(p), least[r]) for (d, _), p, r in zip(given, prints, roots)]
        assert sorted(map(tuple, near_duplicates(df).collect()), key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("most", [1, 4])
def test_components_of_crowded_fingerprints(spark, most):
    """Chains, a dense ball of thousands of neighbours, and strays next to it."""
    rng = random.Random(most)
    ball = {0b1111 << 20 ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)}
    chain, at = set(), (1 << 63) | 0xFFFF00
    for _ in range(20):
        chain.add(at)
        for _ in range(most or 1):
            at ^= 1 << rng.randrange(64)
    prints = sorted(ball | chain | {rng.getrandbits(64) for _ in range(100)})
    nodes = spark.createDataFrame([(signed(p), 1) for p in prints], "fp long, copies long")
    found = {r.fp: r.root for r in linked(nodes, most).collect()}
    roots = smallest(prints, most)
    groups = {}
    for p, r in zip(prints, roots):
        groups.setdefault(r, set()).add(signed(p))
    assert {frozenset(g) for g in groups.values()} == {frozenset(p for p in found if found[p] == r) for r in set(found.values())}


def test_thresholds_keep_the_promise():
    import numpy as np

    share = np.linspace(0.1, 0.9, 64)
    both = np.outer(share, share) * 1000
    np.fill_diagonal(both, share * 1000)
    for m in range(1, 6):
        parts = correlated_parts(1000, both, m)
        assert sorted(b for p in parts for b in p) == list(range(64))
        for total in (100, 10**6, 10**9):
            _, thresholds = allocate(total, share, parts, 4)
            assert sum(t + 1 for t in thresholds) == 5


def test_one_of_each(docs, odd):
    text = "a fairly long text of many words that two documents share as it is"
    kept = one_of_each(docs((3, text), (1, text), (2, "another text that has nothing to do with it"), (None, text), (None, None)))
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 1), (False, 2), (True, None), (True, None)]
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in one_of_each(odd).collect() if r.doc_id) == [1, 4, 6, 6, 7, 8]


def test_nothing(none):
    assert near_duplicates(none).collect() == []
    assert one_of_each(none).collect() == []


def test_long_texts_are_hashed_whole():
    words = [str(i).encode() for i in range(simhash.STEP + 50)]
    assert sum(map(len, simhash.shingle_hashes(words, 4))) == len(words) - 3
