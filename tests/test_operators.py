"""Operators on small tables with answers worked out by hand."""

import pytest
from pyspark.sql import functions as F

from dirlens.operators import anomaly, counts, coverage, hierarchy, integrity, linkage, overlap, reconcile, sampling
from dirlens.plans.reports import REPORTS
from dirlens.schema import NPI_SYSTEM_A, NPI_SYSTEM_B, NPI_SYSTEMS, SPECIALTY_SYSTEM

A, B = "dataset-a", "dataset-b"


def npi(value, system=NPI_SYSTEM_A):
    return {"system": system, "value": value}


def ref(kind, ident):
    return {"reference": f"{kind}/{ident}"}


# --- coverage ------------------------------------------------------------------------------


def test_completeness_counts_nodes_and_texts(table, rows):
    t = table(
        "practitioners",
        (A, {"id": "1", "qualification": None, "gender": None}),
        (A, {"id": "2", "gender": "male"}),
        (A, {"id": "3"}),
        (B, {"id": "4", "qualification": []}),
    )
    got = rows(coverage.field_completeness(t, {"q": "has_qualification", "g": "has_gender"}))
    assert got == [
        {"source_dataset": A, "total": 3, "q": 33.3, "g": 33.3},
        {"source_dataset": B, "total": 1, "q": 100.0, "g": 0.0},
    ]


def test_completeness_of_an_empty_table(table, rows):
    t = table("practitioners", (A, {"id": "1"})).limit(0)
    assert rows(coverage.field_completeness(t, {"g": "has_gender"})) == []


def test_extension_denominators(table, rows):
    url = [{"url": "http://x/network-1"}]
    t = table("practitioner_roles", (A, {"id": "1", "extension": url}), (A, {"id": "2", "extension": []}),
              (A, {"id": "3"}), (B, {"id": "4"}))
    of = lambda d: rows(coverage.extension_coverage(t, "network", "n", "p", "t", d))
    assert of("rows") == [
        {"source_dataset": A, "t": 3, "n": 1, "p": 33.3}, {"source_dataset": B, "t": 1, "n": 0, "p": 0.0},
    ]
    assert of("with_extension") == [
        {"source_dataset": A, "t": 3, "n": 1, "p": 50.0}, {"source_dataset": B, "t": 1, "n": 0, "p": None},
    ]
    assert of("only_rows_with_extension") == [{"source_dataset": A, "t": 2, "n": 1, "p": 50.0}]
    with pytest.raises(ValueError):
        of("other")


def test_coding_denominators(table, rows):
    nucc = [{"coding": [{"system": "other"}, {"system": SPECIALTY_SYSTEM, "code": "c"}]}]
    t = table("practitioner_roles", (A, {"id": "1", "specialty": nucc}), (A, {"id": "2", "specialty": [{}]}),
              (A, {"id": "3"}), (B, {"id": "4"}))
    of = lambda d: rows(
        coverage.coding_coverage(t, "specialty_codings", SPECIALTY_SYSTEM, "n", "p", "has_specialty", "t", d)
    )
    assert of("present") == [{"source_dataset": A, "t": 2, "n": 1, "p": 50.0}]
    assert of("rows") == [
        {"source_dataset": A, "t": 3, "n": 1, "p": 33.3}, {"source_dataset": B, "t": 1, "n": 0, "p": 0.0},
    ]


def test_array_lengths_ignore_rows_without_the_array(table, rows):
    t = table("practitioners", (A, {"id": "1", "qualification": [{}, {}]}), (A, {"id": "2", "qualification": []}),
              (A, {"id": "3"}), (B, {"id": "4"}))
    got = rows(coverage.array_length_stats(t, "qualification_size", "has_qualification", ("avg", "max", "min")))
    assert got == [{"source_dataset": A, "avg": 1.0, "max": 2, "min": 0}]


def test_qualification_depth(directory, rows):
    d = directory(practitioners=[
        (A, {"id": "1", "qualification": [{"code": None}, {"issuer": ref("Organization", 1)}]}),
        (A, {"id": "2", "qualification": [{"period": {}, "extension": [{"url": "x/qualification-y"}]}]}),
        (A, {"id": "3", "qualification": []}),
    ])
    assert rows(REPORTS["qualification_depth"](d)) == [{
        "source_dataset": A, "total": 3, "has_qualification": 3, "has_qual_code": 1, "has_qual_issuer": 1,
        "has_qual_period": 1, "has_qual_extension": 1,
    }]


def test_contact_invariant(directory, rows):
    d = directory(practitioner_roles=[
        (A, {"id": "1", "telecom": []}), (A, {"id": "2", "endpoint": None}),
        (A, {"id": "3", "telecom": [], "endpoint": []}), (A, {"id": "4"}),
    ])
    assert rows(REPORTS["role_contact_invariant"](d)) == [{
        "source_dataset": A, "total": 4, "has_telecom": 2, "has_endpoint": 2, "has_telecom_or_endpoint": 3,
        "missing_both": 1, "pct_missing_both": 25.0,
    }]


# --- counts --------------------------------------------------------------------------------


def test_value_counts_ties_nulls_and_limits(table, rows):
    ids = lambda *s: [{"system": x} if x else {} for x in s]
    t = table("practitioners", (A, {"id": "1", "identifier": ids("b", "a", None)}),
              (A, {"id": "2", "identifier": ids("b", "a")}), (A, {"id": "3", "identifier": []}),
              (B, {"id": "4", "identifier": ids("z")}), (B, {"id": "5", "identifier": {"system": "S"}}))
    full = counts.value_counts(t, {"system": "element.system"}, "identifiers")
    expected = [(A, "a", 2), (A, "b", 2), (A, None, 1), (B, "z", 1)]
    assert [tuple(r) for r in full.collect()] == expected
    limited = counts.value_counts(t, {"system": "element.system"}, "identifiers", limit=2)
    assert [tuple(r) for r in limited.collect()] == expected[:2]
    each = counts.value_counts(t, {"system": "element.system"}, "identifiers", per_dataset=1)
    assert [tuple(r) for r in each.collect()] == [expected[0], expected[3]]


def test_weekdays_keep_their_json_form(directory, rows):
    d = directory(practitioner_roles=[
        (A, {"id": "1", "availableTime": [{"daysOfWeek": ["tue", "mon"]}, {"allDay": True}]}),
        (A, {"id": "2", "availableTime": [{"daysOfWeek": ["mon"]}]}),
    ])
    got = [tuple(r) for r in REPORTS["availability_weekdays"](d).collect()]
    assert got == [(A, '"mon"', 2), (A, '"tue"', 1)]


def test_connection_types_keep_null_members(directory):
    d = directory(endpoints=[
        (A, {"id": "1", "connectionType": {}}), (A, {"id": "2", "connectionType": {"code": "c"}}),
        (A, {"id": "3"}),
    ])
    got = {tuple(r) for r in REPORTS["endpoint_connection_types"](d).collect()}
    assert got == {(A, None, None, 1), (A, None, "c", 1)}


def test_freshness_compares_text_or_time(table):
    stamp = lambda s: {"meta": {"lastUpdated": s}}
    t = table("organizations", (A, {"id": "1", **stamp("2024-01-01T10:00:00+05:00")}),
              (A, {"id": "2", **stamp("2024-01-01T09:00:00Z")}), (A, {"id": "3"}),
              ("another", {"id": "4", **stamp("2023")}))
    other, text = counts.freshness({"o": t}).collect()
    assert tuple(other) == ("o", "another", 1, "2023", "2023")
    assert (text.has_last_updated, text.earliest, text.latest) == (
        2, "2024-01-01T09:00:00Z", "2024-01-01T10:00:00+05:00",
    )
    _, typed = counts.freshness({"o": t}, typed=True).collect()
    assert (typed.earliest.hour, typed.latest.hour) == (5, 9)


def test_record_counts_and_comparison(directory, rows):
    d = directory(organizations=[(A, {"id": "1"}), (A, {"id": "2"}), (B, {"id": "1"})], endpoints=[(A, {"id": "9"})])
    assert [tuple(r) for r in REPORTS["record_counts"](d).collect()] == [
        ("endpoints", A, 1), ("organizations", A, 2), ("organizations", B, 1),
    ]
    assert [tuple(r) for r in REPORTS["dataset_comparison"](d).collect()] == [
        ("endpoints", 1, None, None), ("organizations", 2, 1, 2.0), ("TOTAL", 3, 1, 3.0),
    ]


# --- overlap -------------------------------------------------------------------------------


def test_key_overlap(table):
    t = table("organizations", *[(A, {"id": i}) for i in "123"], *[(B, {"id": i}) for i in "34"])
    assert tuple(overlap.key_overlap(t, "o").first()) == ("o", 3, 2, 1, 2, 1)


def test_value_overlap_with_a_null_value(table):
    t = table(
        "practitioners",
        (A, {"id": "1", "identifier": [npi("7"), npi("7", NPI_SYSTEM_B)]}),
        (A, {"id": "2", "identifier": [npi("8"), {"system": "other", "value": "9"}]}),
        (B, {"id": "3", "identifier": [npi("8", NPI_SYSTEM_B)]}),
        (B, {"id": "4", "identifier": [{"system": NPI_SYSTEM_B}]}),
        (B, {"id": "5", "identifier": [npi("9", NPI_SYSTEM_B)]}),
    )
    assert tuple(overlap.value_overlap(t, NPI_SYSTEMS).first()) == (2, 2, 1, 1, 1)
    assert tuple(overlap.value_overlap(t, NPI_SYSTEMS, strict_not_in=True).first()) == (2, 2, 1, 0, 1)


def test_fragmentation_counts_a_document_once(table, rows):
    t = table("organizations", (A, {"id": "1", "identifier": [npi("7"), npi("7")]}),
              (A, {"id": "2", "identifier": [npi("7")]}), (A, {"id": "3", "identifier": [npi("8")]}))
    assert rows(overlap.identifier_fragmentation(t, NPI_SYSTEMS)) == [{
        "source_dataset": A, "distinct_values": 2, "value_owner_pairs": 3, "values_with_many_owners": 1,
        "max_owners": 2, "avg_owners": 1.5,
    }]


# --- integrity -----------------------------------------------------------------------------


def test_references_missing_empty_dangling_and_absolute(table, rows):
    orgs = table("organizations", (A, {"id": "1"}), (B, {"id": "2"}), ("dataset-c", {"id": "3"}))
    t = table(
        "practitioner_roles",
        (A, {"id": "r1", "organization": ref("Organization", 1)}),
        (A, {"id": "r2", "organization": ref("Organization", 2)}),
        (A, {"id": "r3", "organization": {"display": "x"}}),
        (A, {"id": "r4"}),
        (B, {"id": "r5", "organization": {"reference": "http://h/fhir/Organization/2"}}),
    )
    fields = {"o": ("has_organization", "organization_ref")}
    last = rows(integrity.resolve_references(t, fields, orgs, "last"))
    assert last == [
        {"source_dataset": A, "total": 4, "missing_o": 1, "present_o": 3, "resolved_o": 1, "unresolved_o": 2, "pct_o": 33.3},
        {"source_dataset": B, "total": 1, "missing_o": 0, "present_o": 1, "resolved_o": 1, "unresolved_o": 0, "pct_o": 100.0},
    ]
    second = rows(integrity.resolve_references(t, fields, orgs, "segment2"))
    assert [r["resolved_o"] for r in second] == [1, 0]


def test_two_fields_share_a_pass(table, rows):
    orgs = table("organizations", (A, {"id": "1"}))
    t = table("organization_affiliations",
              (A, {"id": "f", "organization": ref("Organization", 1), "participatingOrganization": ref("Organization", 9)}),
              (A, {"id": "g", "organization": ref("Organization", 1)}))
    fields = {"p": ("has_participatingOrganization", "participating_ref"), "o": ("has_organization", "organization_ref")}
    (got,) = rows(integrity.resolve_references(t, fields, orgs))
    assert (got["total"], got["resolved_o"], got["unresolved_p"], got["missing_p"]) == (2, 2, 1, 1)


def test_any_reference_of_a_list_resolves(table, rows):
    locations = table("locations", (A, {"id": "1"}), (A, {"id": "2"}))
    t = table(
        "practitioner_roles",
        (A, {"id": "r1", "location": [ref("Location", 1), ref("Location", 2), ref("Location", 9)]}),
        (A, {"id": "r2", "location": [ref("Location", 9)]}),
        (A, {"id": "r3", "location": []}),
        (A, {"id": "r4", "location": [{"display": "x"}]}),
        (A, {"id": "r5"}),
    )
    got = rows(integrity.resolve_reference_lists(t, "has_location", "location_refs", locations))
    assert got == [{
        "source_dataset": A, "total": 5, "missing": 1, "present": 4, "resolved": 1, "n_references": 5,
        "resolved_references": 2,
    }]


# --- linkage -------------------------------------------------------------------------------


def test_linked_coverage_needs_the_key_and_survives_fanout(directory, rows):
    role = lambda i, p: (A, {"id": i, "practitioner": ref("Practitioner", p)})
    d = directory(
        practitioners=[
            (A, {"id": "1", "identifier": [npi("7"), npi("7", NPI_SYSTEM_B)]}),
            (A, {"id": "2", "identifier": [npi("8")]}), (A, {"id": "3"}),
        ],
        practitioner_roles=[role("r1", "1"), role("r2", "1"), role("r3", "3"), role("r4", "9"),
                            (A, {"id": "r5", "practitioner": {"display": "x"}})],
    )
    assert rows(REPORTS["practitioner_role_coverage"](d)) == [{
        "source_dataset": A, "total_practitioners": 2, "practitioners_with_role": 1, "pct_with_role": 50.0,
        "practitioners_without_role": 1,
    }]


def test_directory_completeness_joins_flags_of_any_role(directory, rows):
    full = {"active": True, "name": [{"text": "n"}], "identifier": [npi("7")]}
    nucc = [{"coding": [{"system": SPECIALTY_SYSTEM}]}]
    link = {"practitioner": ref("Practitioner", 1)}
    d = directory(
        practitioners=[(A, {"id": "1", **full}), (A, {"id": "2", **full, "gender": "male"})],
        practitioner_roles=[
            (A, {"id": "r1", **link, "specialty": nucc}),
            (A, {"id": "r2", **link, "telecom": [], "organization": ref("Organization", 1)}),
        ],
    )
    (got,) = rows(REPORTS["directory_completeness"](d))
    assert got == {
        "source_dataset": A, "total_practitioners": 2, "pct_npi": 100.0, "pct_active": 100.0, "pct_name": 100.0,
        "pct_gender": 50.0, "pct_qualification": 0.0, "pct_with_any_role": 50.0, "pct_with_specialty_via_role": 50.0,
        "pct_with_nucc_specialty": 50.0, "pct_with_location_or_org": 50.0, "pct_with_contact": 50.0,
        "pct_with_availability": 0.0, "pct_with_new_patients": 0.0, "pct_with_network": 0.0,
        "pct_directory_complete": 50.0,
    }


def test_fanout_has_a_group_for_references_without_an_id(directory, rows):
    role = lambda i, p: (A, {"id": i, "practitioner": p})
    one, two = ref("Practitioner", 1), ref("Practitioner", 2)
    d = directory(practitioner_roles=[
        role("1", one), role("2", one), role("3", one), role("4", two),
        role("5", {"display": "x"}), role("6", {"display": "y"}), (A, {"id": "7"}),
    ])
    assert rows(REPORTS["roles_per_practitioner"](d)) == [{
        "source_dataset": A, "min_roles": 1, "max_roles": 3, "avg_roles": 2.0, "median_roles": 2.0,
        "practitioners_with_1_role": 1, "practitioners_with_2_roles": 1, "practitioners_with_3plus_roles": 1,
    }]


def test_median_between_two_counts(directory, rows):
    role = lambda i, p: (A, {"id": i, "practitioner": ref("Practitioner", p)})
    d = directory(practitioner_roles=[role("1", 1), role("2", 2), role("3", 2)])
    assert rows(REPORTS["roles_per_practitioner"](d))[0]["median_roles"] == 1.5


# --- hierarchy -----------------------------------------------------------------------------


def child(ident, parent, base=""):
    return (A, {"id": ident, "partOf": {"reference": f"{base}Organization/{parent}"}})


def test_depth_of_a_chain(table, rows):
    # d -> c -> b -> a: rows of depth 1 for b, c, d; 2 for c, d; 3 for d.
    t = table("organizations", (A, {"id": "a"}), child("b", "a"), child("c", "b"), child("d", "c"))
    assert rows(hierarchy.hierarchy_depth(t)) == [
        {"source_dataset": A, "max_hierarchy_depth": 3, "avg_depth": (1 * 3 + 2 * 2 + 3) / 6},
    ]


def test_cycles_stop_at_the_limit(table, rows):
    t = table("organizations", child("8", "9"), child("9", "8"))
    (got,) = rows(hierarchy.hierarchy_depth(t, with_limit=True))
    assert (got["max_hierarchy_depth"], got["avg_depth"], got["at_limit"]) == (10, 5.5, 2)


def test_absolute_parents_need_the_last_segment(table, rows):
    t = table("organizations", (A, {"id": "a"}), child("b", "a", "http://h/fhir/"), child("c", "b", "http://h/fhir/"))
    assert rows(hierarchy.hierarchy_depth(t))[0]["max_hierarchy_depth"] == 1
    assert rows(hierarchy.hierarchy_depth(t, parse="last"))[0]["max_hierarchy_depth"] == 2


def test_dangling_and_nameless_parents_end_a_chain(table, rows):
    t = table("organizations", child("b", "missing"), (A, {"id": "c", "partOf": {"display": "x"}}), child("d", "c"))
    (got,) = rows(hierarchy.hierarchy_depth(t))
    assert (got["max_hierarchy_depth"], got["avg_depth"]) == (2, 1.25)


# --- anomalies, samples, merging -----------------------------------------------------------


def test_oversize_threshold_is_strict(directory, rows):
    d = directory(organizations=[
        (A, {"id": "1", "address": [{}] * 100}), (A, {"id": "2", "address": [{}] * 101, "name": "n"}),
    ])
    (got,) = rows(REPORTS["organization_oversized_arrays"](d))
    assert (got["fhir_id"], got["address_count"], got["telecom_count"], got["name"]) == ("2", 101, None, "n")


def test_shells_and_identifier_quality(directory, rows):
    uuid = "0a1b2c3d-1111-4222-8333-0123456789ab"
    ssn = {"system": "http://hl7.org/fhir/sid/us-ssn", "value": uuid}
    d = directory(organizations=[
        (A, {"id": "1", "name": "n", "identifier": [ssn, ssn]}), (A, {"id": "2", "telecom": []}), (A, {"id": "3"}),
    ])
    (shell,) = rows(REPORTS["shell_records"](d))
    assert (shell["shell"], shell["shell_with_name"], shell["pct_shell"]) == (2, 1, 66.7)
    (quality,) = rows(REPORTS["identifier_quality"](d))
    assert (quality["has_uuid_value"], quality["has_wrong_system"], quality["has_duplicate_identifier"]) == (1, 1, 1)


def test_malformed_arrays(documents, rows):
    t = documents((A, {"id": "1", "identifier": {}}), (A, {"id": "2", "identifier": []}), (A, {"id": "3"}))
    assert rows(anomaly.malformed_arrays(t, {"n": "$.identifier"})) == [{"source_dataset": A, "total": 3, "n": 1}]


def test_practitioner_sample_takes_the_first_npi(directory, rows):
    d = directory(
        practitioners=[
            (A, {"id": "1", "qualification": [{}], "identifier": [{"system": "x", "value": "0"}, npi("7"), npi("8")]}),
            (A, {"id": "2", "qualification": []}), (A, {"id": "3"}),
        ],
        practitioner_roles=[(A, {"id": "r", "practitioner": ref("Practitioner", 1)})],
    )
    got = rows(REPORTS["practitioner_sample"](d))
    assert [(r["fhir_id"], r["npi"], r["qual_count"], r["role_count"]) for r in got] == [("1", "7", 1, 1), ("2", None, 0, 0)]


def test_samples_per_dataset(table):
    t = table("practitioners", *[(ds, {"id": i}) for ds in (A, B) for i in "cab"])
    first = sampling.sample_records(t, ["source_dataset", "fhir_id"], 2)
    assert [tuple(r) for r in first.collect()] == [(A, "a"), (A, "b")]
    each = sampling.sample_records(t, ["source_dataset", "fhir_id"], 1, per_dataset=True)
    assert [tuple(r) for r in each.collect()] == [(A, "a"), (B, "a")]


def test_identifier_sample_skips_npi_and_missing(directory):
    d = directory(organizations=[
        (A, {"id": "1", "identifier": [npi("7")]}), (A, {"id": "2"}), (A, {"id": "3", "identifier": [{"system": "x"}]}),
        (B, {"id": "4", "identifier": [{"system": "x"}]}),
    ])
    assert [r[0] for r in REPORTS["organization_identifier_sample"](d).collect()] == ['[{"system":"x"}]']


def organization(ds, ident, value, updated=None, system=NPI_SYSTEM_A, **members):
    doc = {"id": ident, "identifier": [npi(value, system)], **members}
    if updated:
        doc["meta"] = {"lastUpdated": updated}
    return (ds, doc)


def test_consolidation_prefers_the_latest_value(table, rows):
    t = table(
        "organizations",
        organization(A, "1", "7", "2024-01-02", name="new"),
        organization(A, "2", "7", "2024-01-01", name="old", telecom=[]),
        organization(A, "3", "8", name="x"), organization(A, "4", "8", name="y"),
    )
    got = {r["npi"]: r for r in rows(reconcile.consolidate(t, NPI_SYSTEMS, ["name", "telecom_json"]))}
    assert (got["7"]["owners"], got["7"]["fhir_id"], got["7"]["name"], got["7"]["telecom_json"]) == (2, "1", "new", "[]")
    assert got["8"]["name"] == "y"


def test_values_of_several_documents_are_merged(table, rows):
    """Each attribute from the latest document that has it; an identity whose documents have none stays."""
    t = table(
        "organizations",
        organization(A, "1", "7", "2024-01-03", telecom=[]), organization(A, "2", "7", "2024-01-02", name="second"), organization(A, "3", "7", "2024-01-01", name="first"),
        organization(A, "4", "8"), organization(B, "1", "7", "2024-02-01", system=NPI_SYSTEM_B, name="of b"),
    )
    got = {(r["source_dataset"], r["npi"]): r for r in rows(reconcile.consolidate(t, NPI_SYSTEMS, ["name", "telecom_json"]))}
    assert (got[A, "7"]["name"], got[A, "7"]["telecom_json"], got[A, "7"]["owners"], got[A, "7"]["fhir_id"]) == ("second", "[]", 3, "1")
    assert (got[A, "8"]["owners"], got[A, "8"]["telecom_json"]) == (1, None)
    assert (got[B, "7"]["name"], got[B, "7"]["owners"]) == ("of b", 1)
    (row,) = rows(reconcile.reconcile(t, NPI_SYSTEMS, "name", ["telecom_json"]))
    assert (row["name"], row["fhir_id"], row["enriching_records"], row["telecom_json"]) == ("of b", "1", 3, "[]")


def test_reconciliation_enriches_the_base(table, rows):
    t = table(
        "organizations",
        organization(B, "b1", "7", system=NPI_SYSTEM_B, name="base"),
        organization(A, "a1", "7", name="other", telecom=[{"value": "1"}]),
        organization(A, "a2", "9", name="unknown to the base"),
    )
    got = rows(reconcile.reconcile(t, NPI_SYSTEMS, "name", ["telecom_json"]))
    assert got == [{
        "npi": "7", "fhir_id": "b1", "name": "base", "enriching_records": 1, "telecom_json": '[{"value":"1"}]',
    }]


def test_fanout_of_no_links(spark):
    empty = spark.createDataFrame([], "source_dataset string, present boolean, id string")
    assert linkage.fanout_distribution(empty, "present", F.col("id")).collect() == []
