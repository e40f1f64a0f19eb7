"""Benchmark items: Myers' distance against dynamic programming, planted passages."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from dirlens.llm import decontaminate
from dirlens.llm.decontaminate import best_stretch, distances, folded, matches, pieces, without_matches


def plain(item, text):
    column, out = list(range(len(item) + 1)), []
    for c in text:
        new = [0]
        for i, p in enumerate(item):
            new.append(min(column[i + 1] + 1, new[i] + 1, column[i] + (p != c)))
        column = new
        out.append(column[-1])
    return out


@settings(max_examples=200, deadline=None)
@given(st.text("ab", min_size=1, max_size=9), st.text("ab", max_size=30))
def test_distances_equal_dynamic_programming(item, text):
    assert list(distances(item, text)) == plain(item, text)
    found = best_stretch(item, text, len(item) - 1)
    least = min(plain(item, text), default=len(item))
    assert (found is None) == (least >= len(item))
    if found:
        distance, start, end = found
        assert distance == least == list(distances(item, text[start:end], anchored=True))[-1] if end > start else least == len(item)


def test_pieces_cover_the_item():
    for n in (1, 2, 20, 83):
        for budget in range(n):
            cut = pieces("x" * n, budget)
            assert len(cut) == budget + 1 and "".join(p for _, p in cut) == "x" * n


def test_planted_passages(spark, docs, odd):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    passage = [" ".join(word() for _ in range(30)) for _ in range(6)]
    prose = [" ".join(word() for _ in range(80)) for _ in range(14)]
    rows, expected = [], set()
    for i, text in enumerate(prose):
        item = passage[i % 6]
        if i < 6:
            text = f"{text[:100]}{item.upper() if i % 2 else item}{text[100:]}"
            expected.add((i, i % 6, 0, 100, 100 + len(item)))
        elif i < 12:
            edited = list(item)
            for at in rng.sample(range(len(item)), int(len(item) * decontaminate.RATE)):
                edited[at] = "#"
            text = f"{text} {''.join(edited)}"
        rows.append((i, text))
    items = spark.createDataFrame([*enumerate(passage), (None, passage[0]), (7, None), (8, " "), (0, passage[0])], "item_id long, text string")
    table = docs(*rows, (50, None), (51, ""), (None, "nothing"))
    found = {tuple(r) for r in matches(table, items).collect()}
    assert expected <= found
    assert {(d, i) for d, i, *_ in found} == {(i, i % 6) for i in range(12)}
    kept = without_matches(table, items)
    assert kept.columns == table.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["12", "13", "50", "51", "None"])
    assert matches(odd, items).collect() == [] and without_matches(odd, items).count() == odd.count()
    assert matches(table, items.limit(0)).collect() == [] and without_matches(table, items.limit(0)).count() == table.count()
    assert matches(table.limit(0), items).collect() == []


def test_portions_give_the_same(spark, docs, monkeypatch):
    items = spark.createDataFrame([(i, f"item number {i} with a passage of its own kind") for i in range(5)], "item_id long, text string")
    table = docs(*((i, f"before item number {i} with a passage of its own kind after") for i in range(5)))
    whole = sorted(map(tuple, matches(table, items, rate=0.0).collect()))
    monkeypatch.setattr(decontaminate, "ITEM_CHARS", 60)
    assert sorted(map(tuple, matches(table, items, rate=0.0).collect())) == whole and len(whole) == 5
    assert without_matches(table, items, rate=0.0).count() == 0


def test_folding_keeps_places():
    assert folded("İstanbul É") == "İstanbul é"


def test_items_without_id_or_letters(spark, docs):
    passage = "a passage of its own kind that nobody else has written down"
    items = spark.createDataFrame([(None, passage), (1, "\n"), (2, "\t \u2003"), (3, "\x1c"), (4, "")], "item_id long, text string")
    table = docs((1, f"before {passage} after"), (2, "two\nlines\tand \u2003 \x1c more"), (3, None))
    assert sorted(r.doc_id for r in without_matches(table, items).collect()) == [2, 3]
    assert matches(table, items).collect() == []


def test_layout_takes_no_edits(spark, docs):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(34)]
    item, lines = " ".join(words), [" ".join(words[i : i + 6]) for i in range(0, 34, 6)]
    spread, quoted = "  ".join(words), "\n\t    ".join(lines)
    rows = [(1, f"so:  {spread}  end"), (2, f"{quoted}\n"), (3, item), (4, f"{' '.join(words[:20])}  other words")]
    found = {tuple(r) for given in (item, spread) for r in matches(docs(*rows), spark.createDataFrame([(7, given)], "item_id long, text string")).collect()}
    assert found == {(1, 7, 0, 5, 5 + len(spread)), (2, 7, 0, 0, len(quoted)), (3, 7, 0, 0, len(item))}
    # an edit in the middle of a run costs no more than it did
    matcher = decontaminate.Matcher([(1, "ab   cd" + "x" * 8)], 0.07)
    assert matcher.find("ab # cd" + "x" * 8) == [(1, 1, 0, 15)]


def test_texts_of_one_item_in_any_portions(docs, spark, monkeypatch):
    """The best of an item's texts for each row, whether one portion holds them or each its own; repeated rows are reported each."""
    long = "the quick brown fox jumps over the lazy dog and runs far away"
    texts = [(1, long), (1, long.replace("quick", "quack")), (1, "something else that is long enough here"), (2, "something else that is long enough here")]
    items = spark.createDataFrame(texts, "item_id long, text string")
    rows = [(7, f"x {long} y"), (7, f"x {long} y"), (8, "and something else that is long enough here"), (None, long), (9, "nothing")]
    found = []
    for size in (1 << 20, 1):
        monkeypatch.setattr(decontaminate, "ITEM_CHARS", size)
        found.append(sorted(map(tuple, matches(docs(*rows), items).collect()), key=str))
    assert found[0] == found[1] and [r[:3] for r in found[0]] == [(7, 1, 0), (7, 1, 0), (8, 1, 0), (8, 2, 0), (None, 1, 0)]
