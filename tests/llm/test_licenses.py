"""Licences: base phrases by plain loops, rules and their overlaps by a plain version with Python's regular expressions."""

import re

from dirlens.llm import licenses, queries
from dirlens.llm.license_rules import CERTAINTY, NAME, NOTICE, RULES, TAG, TERMS, Rule, needs_licence

TEXTS = [
    "Released under the MIT License. See mit-license; MIT\nLICENSE mit licenses", "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0. apache license", "mit License " * 50,
    "GNU Lesser General Public License v2.1 or later (LGPL-2.1)", "SPDX-License-Identifier: (GPL-2.0-only OR MIT)", "mit einer Lizenz; public domain beer",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "éMIT license ſmit LICENSE mıt license İ license", "",
    "mit", "license", "no licence at all, generally public", "dedicated to the public domain: mit\x00license, mit\x7flicense", "Mozilla Public License 2.0, MPL 2.0; BSD 3-Clause; zlib license",
]
PHRASES = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_base(text):
    words = words_of(text)
    found = [(i, label) for label, p in PHRASES.items() for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return (len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found})))


def plain_detections(text, rules=RULES):
    """(first, last, rule) of every match, and those that no other contains."""
    norm = " ".join(words_of(text))
    found = []
    for n, r in enumerate(rules):
        for m in re.finditer(rf"(?<![^ ])(?:{r.pattern})(?![^ ])", norm):
            found.append((norm[: m.start()].count(" "), norm[: m.end()].count(" ") + 1, n))

    def inside(a, b):
        """b takes a out."""
        same = a[:2] == b[:2]
        return rules[b[2]].tier <= rules[a[2]].tier and ((same and b[2] < a[2]) or (not same and b[0] <= a[0] and a[1] <= b[1]))

    return found, [a for a in found if not any(inside(a, b) for b in found)]


def test_query_equals_plain_version(docs, odd):
    for df in (docs(*enumerate(TEXTS), (None, TEXTS[0]), (3, TEXTS[3]), (98, None)), odd):
        rows = licenses.summary(df).collect()
        base = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows]
        assert sorted(base, key=str) == sorted([(r.doc_id, *plain_base(r.text or "")) for r in df.collect()], key=str)
        expected = []
        for r in df.collect():
            found, stay = plain_detections(r.text or "")
            labels = {RULES[n].label for _, _, n in stay} | {RULES[n].label for _, _, n in found if RULES[n].base}
            spans = ",".join(f"{RULES[n].label}:{a}:{b}" for a, b, n in sorted(stay, key=lambda x: (x[0], -x[1], x[2])))
            doubt = 1.0
            for n in sorted({n for _, _, n in stay} | {n for _, _, n in found if RULES[n].base}):
                doubt *= 1 - CERTAINTY[RULES[n].tier]
            expected.append((r.doc_id, ",".join(sorted(labels)), spans, round(1 - doubt, 9)))
        assert sorted([(r.doc_id, r.labels, r.spans, round(r.score, 9)) for r in rows], key=str) == sorted(expected, key=str)


def test_labels_of_plain_statements(docs):
    got = {r.doc_id: r for r in licenses.summary(docs(*enumerate(TEXTS))).collect()}
    assert got[0].labels == "mit" and got[1].labels == "gpl,gpl-3.0" and got[2].labels == "cc-by-nc-4.0" and got[3].labels == "apache,apache-2.0"
    assert got[5].labels == "gpl,lgpl-2.1" and got[6].labels == "gpl-2.0,mit" and got[8].labels == "mit"
    assert got[7].labels == "" and got[7].score == 0 and got[13].labels == ""
    assert all(0 <= r.score <= 1 for r in got.values())


def test_containment_and_priority(docs):
    rules = [Rule(TERMS, "x", "alpha", "alpha beta"), Rule(NAME, "y", "alpha", "alpha beta gamma"), Rule(NAME, "z", "beta", "beta gamma"), Rule(NAME, "w", "beta", "beta gamma")]
    (row,) = licenses.find(docs((1, "Alpha beta gamma delta")), rules).collect()
    # x isn't contained by a better tier; z and w lie in y; of z and w alone the earlier one would stay
    assert [(s.label, s.kept) for s in row.spans] == [("y", True), ("x", True), ("z", False), ("w", False)]
    (row,) = licenses.find(docs((1, "beta gamma")), rules).collect()
    assert [(s.label, s.kept) for s in row.spans] == [("z", True), ("w", False)]


def test_keywords_lose_no_match():
    """A rule's keyword is a whole word of whatever the rule matches: it stands in the pattern, or in each alternative, outside of groups."""
    group = re.compile(r"\((?:\?:)?[^()]*\)(?:[?*+]|\{[0-9,]+\})*\??")
    assert len(RULES) > 300
    for r in RULES:
        if r.tier in (TAG, NOTICE):
            continue  # these begin with a group of their own and go on with a name
        whole = re.fullmatch(r"\(\?:(.*)\)", r.pattern)
        for part in re.split(r"\|(?![^()]*\))", whole[1]) if whole and r.label.startswith("bsd") else [r.pattern]:
            while group.search(part):
                part = group.sub(" ", part)
            assert r.keyword in part.split(), r
            assert not needs_licence(r.pattern) or re.search(r"\blicen(\[cs\]|[cs])e\b", part), r


def test_empty_table(none):
    assert licenses.summary(none).collect() == []


def test_long_text_with_many_places(docs):
    text = "mit license " * 20_000
    (row,) = licenses.summary(docs((1, text))).collect()
    assert (row.n_words, row.n_base, row.first_word, row.last_word) == (40_000, 20_000, 0, 39_998)


def test_registered_query(spark, tmp_path, docs):
    docs(*enumerate(TEXTS), (None, None)).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.QUERIES["op11_license_scan"](spark, str(tmp_path)).collect()
    assert sorted([(r.doc_id, r.n_words) for r in rows], key=str) == sorted([(i, len(words_of(t))) for i, t in enumerate(TEXTS)] + [(None, 0)], key=str)
