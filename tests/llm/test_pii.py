"""Personal data: patterns as they are given, disclosure by hand."""

import re

from pyspark.sql import functions as F

from dirlens.llm.pii import KINDS, found, sanitised

TEXTS = [
    "a@b.c.d@e.f a@b.c_d@e.f x@y..z q@r.s. %@- a@b", "+1 (017) 555-7713 4111 1111 1111 1111 4111111111111112", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255",
    "é𝒳 foo@bar.com 𝒳 +49 30 1234567 tail", "4111-1111-1111-1111 4111--1111", "+1((((((((((( 9 +12 3", "", "9" * 3000 + " " + "1 " * 2000 + "a." * 2000 + "@x." + "y." * 2000,
]


def digits(text):
    return re.sub("[^0-9]", "", text)


def luhn(number):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain(text):
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda h: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda h: all(int(p) <= 255 for p in h.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda h: 13 <= len(digits(h)) <= 19 and luhn(digits(h))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda h: 9 <= len(digits(h)) <= 15),
    }
    return [(k, *m.span()) for k, (p, ok) in rules.items() for m in re.finditer(p, text) if ok(m[0])]


def test_entities_equal_plain_patterns(docs, odd):
    for df in (docs(*enumerate(TEXTS), (None, TEXTS[3]), (3, TEXTS[3]), (9, None)), odd):
        rows = found(df).collect()
        base = [(r.doc_id, [(s.kind, s.first, s.last) for s in r.spans if s.kind in KINDS]) for r in rows]
        assert sorted(base, key=str) == sorted([(r.doc_id, plain(r.text or "")) for r in df.collect()], key=str)


def test_words_that_reveal_an_entity(docs):
    common = [(100 + i, f"the other note about nothing number{i}") for i in range(30)]
    mail = "write to ann@x.org"
    rows = [(1, f"Zebra the {mail} about nothing"), (2, f"zebra note {mail} the"), (3, f"the quagga {mail}"), (4, f"quagga other{' filler' * 30} note {mail}")]
    spans = {r.doc_id: r for r in found(docs(*rows, *common), window=80).collect()}
    terms = lambda i: {(rows[i - 1][1][s.first : s.last], s.hit) for s in spans[i].spans if s.kind == "term"}
    # N = 34, df(entity) = 4: zebra is in 2 documents, always near it; quagga is in 2, once beyond the window; "the" is everywhere
    assert ("Zebra", "removed") in terms(1) and ("zebra", "removed") in terms(2)
    assert "the" not in {w for i in (1, 2, 3) for w, _ in terms(i)}
    assert "quagga" not in {w for i in (3, 4) for w, _ in terms(i)}
    assert all(not spans[100 + i].spans and spans[100 + i].text is None for i in range(30))


def test_sanitised_text(spark):
    text = "Ann 12 writes ann@x.org é𝒳 now"
    spans = [("email", 14, 23, "ann@x.org"), ("term", 0, 3, "generalised"), ("term", 4, 6, "generalised"), ("term", 24, 26, "removed")]
    df = spark.createDataFrame([(text, spans)], "text string, spans array<struct<kind:string,first:bigint,last:bigint,hit:string>>")
    assert df.select(sanitised(F.col("text"), F.col("spans"))).first()[0] == "[name] [number] writes [email]  now"


def test_no_documents(none):
    assert found(none).collect() == []


def disclosed(rows, threshold=0.9, support=2):
    """Per document, (first, last, fate) of the disclosing words, by counting whole documents."""
    ents = [plain(t) for _, t in rows]
    names = [{f"{k}:{digits(t[a:b]) if k in ('card', 'phone') else t[a:b].lower()}" for k, a, b in e} for (_, t), e in zip(rows, ents)]
    words = [[(m[0].lower(), *m.span()) for m in re.finditer(r"[^\W_]+", t)] for _, t in rows]
    bags, n = [{w for w, _, _ in ws} for ws in words], len(rows)
    df = lambda sets, x: sum(x in s for s in sets)

    def fate(c, t):
        df_c, joint = df(names, c), sum(c in e and t in b for e, b in zip(names, bags))
        told = joint * n / (df_c * df(bags, t))
        return "" if df_c == n or joint < support or told < (n / df_c) ** threshold else "removed" if told >= n / df_c else "generalised"

    clear = lambda e, a, b: not any(x < b and a < y for _, x, y in e)
    return {
        i: sorted((a, b, f) for w, a, b in ws if clear(e, a, b) and (f := max(fate(c, w) for c in cs))) if cs else []
        for (i, _), e, cs, ws in zip(rows, ents, names, words)
    }


def test_words_met_once_disclose_nothing(docs):
    """An entity that occurs once would be revealed by each rare word beside it; so would a word that meets it once."""
    rows = [(1, "unique words beside ann@x.org here"), (2, "bob@y.org quokka one"), (3, "bob@y.org quokka two"), *((10 + i, f"plain {i % 3}") for i in range(30))]
    for support in (1, 2, 3):
        got = {r.doc_id: [(s.first, s.last, s.hit) for s in r.spans if s.kind == "term"] for r in found(docs(*rows), support=support).collect()}
        assert got == disclosed(rows, support=support)
        assert bool(got[1]) == (support == 1) and bool(got[2]) == (support < 3)


def test_query_counts_and_marks_whole_documents(spark, tmp_path, monkeypatch):
    from dirlens.llm import pii, queries

    far = " filler" * 400
    rows = [(i, f"Zebra{far if i > 2 else ''} note {'' if i % 3 else 'ann '}write ann@x.org from +1 017 555-771{i % 2}3 the zebra") for i in range(9)]
    rows += [(10, "Mia mia@x.org" + far + " mia Quagga"), (11, "quagga" + far + " é𝒳 mia mia@x.org"), (12, "quagga the from")]
    rows += [(100 + i, f"the other{' filler' if i % 2 else ''} note about nothing number{i % 7}") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    expected = disclosed(rows)
    assert {f for spans in expected.values() for *_, f in spans} == {"removed", "generalised"}
    for frequent in (1 << 16, 8):
        monkeypatch.setattr(pii, "FREQUENT", frequent)
        got = found(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()
        assert {r.doc_id: [(s.first, s.last, s.hit) for s in r.spans if s.kind == "term"] for r in got} == expected
    # in the header, far from the entity: the word has a span in the query's rows
    lines = queries.op8_pii(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_removed, r.n_generalised) for r in lines} == {
        i: tuple(sum(f == fate for *_, f in spans) for fate in ("removed", "generalised")) for i, spans in expected.items()
    }
    spans = {r.doc_id: r.spans for r in lines}
    assert all("term:0:5" in spans[i] for i in range(9)), spans[8]
