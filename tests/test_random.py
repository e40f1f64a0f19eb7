"""Operators against brute force on random directories."""

import random
from collections import Counter, defaultdict
from statistics import median

import pytest

from dirlens.operators import hierarchy, integrity, linkage, overlap
from dirlens.plans.reports import REPORTS
from dirlens.functions.references import last_segment
from dirlens.schema import NPI_SYSTEM_A, NPI_SYSTEM_B, NPI_SYSTEMS
from pyspark.sql import functions as F

DATASETS = ("dataset-a", "dataset-b")


def maybe(rng, share, value):
    return value if rng.random() < share else None


def build(seed):
    """Organizations, practitioners, roles and locations with hot ids, dangling and missing parts."""
    rng = random.Random(seed)

    def ref(kind, ident):
        shape = rng.random()
        if shape < 0.1:
            return {"display": "nameless"}
        return {"reference": (f"http://h/fhir/{kind}/{ident}" if shape < 0.3 else f"{kind}/{ident}")}

    def drop_none(doc):
        return {k: v for k, v in doc.items() if v is not None}

    def some_id(n):
        return "0" if rng.random() < 0.33 else str(rng.randrange(n + 5))

    tables = defaultdict(list)
    for ds in DATASETS:
        for i in range(40):
            tables["organizations"].append((ds, drop_none({"id": str(i), "partOf": maybe(rng, 0.7, ref("Organization", some_id(40)))})))
        for i in rng.sample(range(60), 45):
            ids = [
                drop_none({"system": rng.choice([NPI_SYSTEM_A, NPI_SYSTEM_B, "other"]), "value": maybe(rng, 0.95, str(rng.randrange(50)))})
                for _ in range(rng.randrange(4))
            ]
            tables["practitioners"].append((ds, drop_none({"id": str(i), "identifier": maybe(rng, 0.9, ids)})))
        for i in range(30):
            tables["locations"].append((ds, {"id": str(i)}))
        for i in range(200):
            tables["practitioner_roles"].append((ds, drop_none({
                "id": f"r{i}",
                "practitioner": maybe(rng, 0.9, ref("Practitioner", some_id(60))),
                "organization": maybe(rng, 0.9, ref("Organization", some_id(40))),
                "location": maybe(rng, 0.8, [ref("Location", some_id(30)) for _ in range(rng.randrange(4))]),
            })))
    return tables


def last(reference):
    text = (reference or {}).get("reference")
    return None if text is None else text.rsplit("/", 1)[-1]


def second(reference):
    text = (reference or {}).get("reference")
    parts = (text or "").split("/")
    return None if text is None else (parts[1] if len(parts) > 1 else "")


@pytest.fixture(params=[1, 2, 3])
def tables(request):
    return build(request.param)


def ids(tables, resource, ds):
    return {d["id"] for s, d in tables[resource] if s == ds}


@pytest.mark.parametrize("parse,read", [("last", last), ("segment2", second)])
def test_references(tables, table, rows, parse, read):
    t = table("practitioner_roles", *tables["practitioner_roles"])
    target = table("organizations", *tables["organizations"])
    got = rows(integrity.resolve_references(t, {"o": ("has_organization", "organization_ref")}, target, parse))
    for line, ds in zip(got, DATASETS, strict=True):
        roles = [d for s, d in tables["practitioner_roles"] if s == ds]
        present = [d for d in roles if "organization" in d]
        resolved = [d for d in present if read(d["organization"]) in ids(tables, "organizations", ds)]
        assert (line["total"], line["present_o"], line["resolved_o"]) == (len(roles), len(present), len(resolved))
        assert line["missing_o"] + line["present_o"] == line["total"]
        assert line["resolved_o"] + line["unresolved_o"] == line["present_o"]


def test_reference_lists(tables, table, rows):
    t = table("practitioner_roles", *tables["practitioner_roles"])
    got = rows(integrity.resolve_reference_lists(t, "has_location", "location_refs", table("locations", *tables["locations"])))
    for line, ds in zip(got, DATASETS, strict=True):
        lists = [d.get("location") for s, d in tables["practitioner_roles"] if s == ds]
        known = ids(tables, "locations", ds)
        hits = [[last(r) in known for r in refs or []] for refs in lists]
        assert (line["total"], line["missing"]) == (len(lists), lists.count(None))
        assert line["resolved"] == sum(any(h) for h in hits)
        assert (line["n_references"], line["resolved_references"]) == (sum(map(len, hits)), sum(map(sum, hits)))


@pytest.mark.parametrize("parse,read", [("last", last), ("segment2", second)])
def test_hierarchy(tables, table, rows, parse, read):
    t = table("organizations", *tables["organizations"])
    got = rows(hierarchy.hierarchy_depth(t, parse=parse))
    for line, ds in zip(got, DATASETS, strict=True):
        parent = {d["id"]: read(d["partOf"]) for s, d in tables["organizations"] if s == ds and "partOf" in d}
        depths = []
        for start in parent:
            here, depth = start, 0
            while here in parent and depth < 10:
                depth += 1
                depths.append(depth)
                here = parent[here]
        assert line["max_hierarchy_depth"] == max(depths)
        assert line["avg_depth"] == pytest.approx(sum(depths) / len(depths))


def npis(tables, ds):
    return [
        (d["id"], e.get("value"))
        for s, d in tables["practitioners"] if s == ds
        for e in d.get("identifier", []) if e["system"] in NPI_SYSTEMS
    ]


def test_overlap_and_fragmentation(tables, table, rows):
    t = table("practitioners", *tables["practitioners"])
    a, b = ({v for _, v in npis(tables, ds) if v} for ds in DATASETS)
    assert tuple(overlap.value_overlap(t, NPI_SYSTEMS).first()) == (len(a), len(b), len(a & b), len(a - b), len(b - a))
    total, other, both, only_a, only_b = tuple(overlap.key_overlap(t, "p").first())[1:]
    assert (both + only_a, both + only_b) == (total, other)
    for line, ds in zip(rows(overlap.identifier_fragmentation(t, NPI_SYSTEMS)), DATASETS, strict=True):
        owners = Counter(v for _, v in {p for p in npis(tables, ds) if p[1]})
        assert (line["distinct_values"], line["max_owners"]) == (len(owners), max(owners.values()))
        assert line["values_with_many_owners"] == sum(n > 1 for n in owners.values())


def test_linkage(tables, table, directory, rows):
    t = table("practitioner_roles", *tables["practitioner_roles"])
    got = rows(linkage.fanout_distribution(t, "has_practitioner", last_segment(F.col("practitioner_ref"))))
    d = directory(practitioners=tables["practitioners"], practitioner_roles=tables["practitioner_roles"])
    covered = rows(REPORTS["practitioner_role_coverage"](d))
    for line, cover, ds in zip(got, covered, DATASETS, strict=True):
        roles = Counter(last(x["practitioner"]) for s, x in tables["practitioner_roles"] if s == ds and "practitioner" in x)
        assert (line["min_roles"], line["max_roles"]) == (min(roles.values()), max(roles.values()))
        assert line["median_roles"] == median(roles.values())
        assert line["practitioners_with_1_role"] == sum(n == 1 for n in roles.values())
        keyed = {p for p, _ in npis(tables, ds)}
        assert cover["total_practitioners"] == len(keyed)
        assert cover["practitioners_with_role"] == sum(p in roles for p in keyed)
