"""Member presence and array reading on hand-written documents."""

from pyspark.sql import functions as F

from dirlens.functions.references import reference_format, reference_host, reference_id
from dirlens.functions.variant import (
    array, codings, flat, has_any, has_substring, has_value, malformed, node, text,
)

A = "dataset-a"


def one(documents, document, *columns):
    named = [c.alias(f"c{i}") for i, c in enumerate(columns)]
    return tuple(documents((A, document)).select(*named).first())


def test_explicit_null_is_a_node_but_no_text(documents):
    doc = {"id": "1", "qualification": None, "gender": None}
    assert one(documents, doc, node("doc", "$.qualification"), text("doc", "$.gender")) == (True, None)


def test_missing_member_is_neither(documents):
    assert one(documents, {"id": "1"}, node("doc", "$.gender"), text("doc", "$.gender")) == (False, None)


def test_text_of_scalars_and_objects(documents):
    doc = {"id": "1", "active": True, "name": [{"text": "n"}], "o": {"b": 1}}
    got = one(documents, doc, text("doc", "$.active"), text("doc", "$.name[0].text"), text("doc", "$.o"))
    assert got == ("true", "n", '{"b":1}')


def test_index_into_an_object_is_null(documents):
    assert one(documents, {"id": "1", "name": {"text": "n"}}, text("doc", "$.name[0].text")) == (None,)


def test_arrays_missing_null_object_and_empty(documents):
    size = F.size(array("doc", "$.identifier"))
    assert one(documents, {"id": "1"}, size) == (None,)
    assert one(documents, {"id": "1", "identifier": None}, size) == (None,)
    assert one(documents, {"id": "1", "identifier": {"system": "S"}}, size) == (None,)
    assert one(documents, {"id": "1", "identifier": []}, size) == (0,)


def test_malformed_is_only_a_value_of_another_kind(documents):
    bad = malformed("doc", "$.identifier")
    assert one(documents, {"id": "1", "identifier": {"system": "S"}}, bad) == (True,)
    assert one(documents, {"id": "1", "identifier": None}, bad) == (False,)
    assert one(documents, {"id": "1", "identifier": []}, bad) == (False,)
    assert one(documents, {"id": "1"}, bad) == (False,)


def test_codings_skip_concepts_without_coding(documents):
    doc = {"id": "1", "specialty": [{"coding": [{"system": "s", "code": "c"}]}, {"text": "free"}]}
    (got,) = one(documents, doc, codings("doc", "$.specialty"))
    assert [tuple(c) for c in got] == [("s", "c", None)]


def test_flat_of_null_is_null(documents):
    assert one(documents, {"id": "1"}, codings("doc", "$.specialty")) == (None,)
    empty = flat(F.array(F.lit(None).cast("array<int>"), F.array(F.lit(1))))
    assert one(documents, {"id": "1"}, empty) == ([1],)


def test_membership_of_missing_arrays_is_false(documents):
    missing = F.lit(None).cast("array<string>")
    held = F.array(F.lit("ab"), F.lit(None).cast("string"))
    got = one(
        documents, {"id": "1"}, has_value(missing, "a"), has_any(missing, ["a"]), has_substring(missing, "a"),
        has_value(held, "ab"), has_value(held, "x"), has_any(held, ["x"]), has_substring(held, "b"),
        has_substring(held, "B"),
    )
    assert got == (False, False, False, True, False, False, True, False)


def test_last_of_repeated_members_wins(documents):
    assert one(documents, '{"id":"a","id":"b"}', text("doc", "$.id")) == ("b",)


def test_reference_parsers(documents):
    relative, absolute = F.lit("Organization/8"), F.lit("http://h/fhir/Organization/8")
    versioned, contained = F.lit("Organization/8/_history/2"), F.lit("#x")
    parse = lambda how: [reference_id(r, how) for r in (relative, absolute, versioned, contained)]
    assert one(documents, {"id": "1"}, *parse("segment2")) == ("8", "", "8", "")
    assert one(documents, {"id": "1"}, *parse("last")) == ("8", "8", "2", "#x")
    assert one(documents, {"id": "1"}, *parse("strict")) == ("8", "8", "8", None)
    null = F.lit(None).cast("string")
    assert one(documents, {"id": "1"}, reference_id(null, "last"), reference_id(null, "segment2")) == (None, None)


def test_reference_formats(documents):
    refs = [F.lit("Organization/8"), F.lit("http://h/fhir/Organization/8"), F.lit("#x"), F.lit(None).cast("string")]
    assert one(documents, {"id": "1"}, *[reference_format(r) for r in refs]) == (
        "relative", "absolute", "other", "none",
    )
    assert one(documents, {"id": "1"}, *[reference_host(r) for r in refs]) == (None, "h", None, None)
