"""The named reports: each one is an operator applied to the tables of a directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirlens.functions.references import last_segment
from dirlens.functions.variant import has_any, has_substring, has_value
from dirlens.operators import anomaly, counts, coverage, hierarchy, integrity, linkage, overlap
from dirlens.operators import reconcile as merging
from dirlens.operators import runs as run_reports
from dirlens.operators import sampling
from dirlens.plans.directory import Directory
from dirlens.schema import NPI_SYSTEM_A, NPI_SYSTEMS, RESOURCES, SPECIALTY_SYSTEM, SSN_SYSTEM

Report = Callable[[Directory], DataFrame]
REPORTS: dict[str, Report] = {}

CODING_FIELDS = {name: f"element.{name}" for name in ("system", "code", "display")}
CORE_RESOURCES = ("organizations", "practitioners", "practitioner_roles")


def report(function: Report) -> Report:
    REPORTS[function.__name__] = function
    return function


def _has_npi() -> Column:
    return has_any(F.col("identifiers").getField("system"), NPI_SYSTEMS)


def _first_npi() -> Column:
    """Value of the first NPI identifier of the record."""
    wanted = F.filter("identifiers", lambda e: e["system"].isin(*NPI_SYSTEMS))
    return F.get(wanted, F.lit(0)).getField("value")


# --- run log -------------------------------------------------------------------------------


@report
def run_report(d: Directory) -> DataFrame:
    return run_reports.run_report(d.runs)


@report
def run_compare(d: Directory) -> DataFrame:
    return run_reports.run_compare(d.runs, latest_only=False)


@report
def run_compare_latest(d: Directory) -> DataFrame:
    return run_reports.run_compare(d.runs)


@report
def run_totals(d: Directory) -> DataFrame:
    return run_reports.run_totals(d.runs)


# --- counts, overlap, freshness ------------------------------------------------------------


@report
def record_counts(d: Directory) -> DataFrame:
    return counts.record_counts({r: d[r] for r in RESOURCES})


@report
def dataset_comparison(d: Directory) -> DataFrame:
    return merging.dataset_comparison(record_counts(d), "resource_type", "record_count")


@report
def organization_id_overlap(d: Directory) -> DataFrame:
    return overlap.key_overlap(d["organizations"], "organizations")


@report
def freshness(d: Directory) -> DataFrame:
    return counts.freshness({r: d[r] for r in RESOURCES if r != "organization_affiliations"})


@report
def freshness_core(d: Directory) -> DataFrame:
    return counts.freshness({r: d[r] for r in CORE_RESOURCES})


@report
def freshness_typed(d: Directory) -> DataFrame:
    return counts.freshness({r: d[r] for r in CORE_RESOURCES}, typed=True)


@report
def practitioner_npi_overlap(d: Directory) -> DataFrame:
    return overlap.value_overlap(d["practitioners"], NPI_SYSTEMS)


@report
def practitioner_npi_overlap_strict(d: Directory) -> DataFrame:
    return overlap.value_overlap(d["practitioners"], NPI_SYSTEMS, strict_not_in=True)


# --- referential integrity -----------------------------------------------------------------


@report
def role_practitioner_refs_relative(d: Directory) -> DataFrame:
    links = {"practitioner": ("has_practitioner", "practitioner_ref")}
    found = integrity.resolve_references(d["practitioner_roles"], links, d["practitioners"], "segment2")
    return found.select(
        "source_dataset",
        F.col("total").alias("total_roles"),
        F.col("missing_practitioner").alias("missing_practitioner_ref"),
        F.col("unresolved_practitioner").alias("unresolved_practitioner_refs"),
        F.col("pct_practitioner").alias("pct_resolve"),
    )


@report
def role_organization_refs_relative(d: Directory) -> DataFrame:
    links = {"org": ("has_organization", "organization_ref")}
    found = integrity.resolve_references(d["practitioner_roles"], links, d["organizations"], "segment2")
    return found.select(
        "source_dataset",
        F.col("missing_org").alias("missing_org_ref"),
        F.col("unresolved_org").alias("unresolved_org_refs"),
        F.col("pct_org").alias("pct_resolve"),
    )


@report
def affiliation_organization_refs(d: Directory) -> DataFrame:
    links = {
        "participating": ("has_participatingOrganization", "participating_ref"),
        "parent": ("has_organization", "organization_ref"),
    }
    found = integrity.resolve_references(
        d["organization_affiliations"], links, d["organizations"], "segment2"
    )
    return found.select(
        "source_dataset",
        F.col("unresolved_participating").alias("unresolved_participating_org"),
        F.col("unresolved_parent").alias("unresolved_parent_org"),
    )


def _managing_refs(d: Directory, resource: str) -> DataFrame:
    links = {"org": ("has_managingOrganization", "managing_ref")}
    return integrity.resolve_references(d[resource], links, d["organizations"], "segment2").select(
        "source_dataset",
        F.col("missing_org").alias("missing_managing_org"),
        F.col("unresolved_org").alias("unresolved_managing_org"),
    )


@report
def location_organization_refs(d: Directory) -> DataFrame:
    return _managing_refs(d, "locations")


@report
def endpoint_organization_refs(d: Directory) -> DataFrame:
    return _managing_refs(d, "endpoints")


def _role_refs(d: Directory, field: str, target: str, short: str) -> DataFrame:
    links = {"ref": (f"has_{field}", f"{field}_ref")}
    return integrity.resolve_references(d["practitioner_roles"], links, d[target], "last").select(
        "source_dataset",
        F.col("total").alias("total_roles"),
        F.col("missing_ref").alias(f"missing_{short}_ref"),
        F.col("present_ref").alias(f"has_{short}_ref"),
        F.col("resolved_ref").alias("resolved"),
        F.col("pct_ref").alias("pct_resolved"),
    )


@report
def role_practitioner_refs(d: Directory) -> DataFrame:
    return _role_refs(d, "practitioner", "practitioners", "practitioner")


@report
def role_organization_refs(d: Directory) -> DataFrame:
    return _role_refs(d, "organization", "organizations", "org")


def _role_locations(d: Directory) -> DataFrame:
    return integrity.resolve_reference_lists(
        d["practitioner_roles"], "has_location", "location_refs", d["locations"]
    )


@report
def role_location_refs(d: Directory) -> DataFrame:
    return _role_locations(d).select(
        "source_dataset",
        F.col("total").alias("total_roles"),
        F.col("missing").alias("missing_location_ref"),
        F.col("present").alias("has_location_ref"),
        F.col("resolved").alias("resolved_count"),
    )


@report
def role_location_single_refs(d: Directory) -> DataFrame:
    return _role_locations(d).select("source_dataset", "n_references", "resolved_references")


@report
def organization_parent_refs(d: Directory) -> DataFrame:
    links = {"parent": ("has_partOf", "parent_ref")}
    organizations = d["organizations"]
    return integrity.resolve_references(organizations, links, organizations, "segment2").select(
        "source_dataset",
        F.col("present_parent").alias("total_with_parent"),
        F.col("resolved_parent").alias("resolved"),
        F.col("pct_parent").alias("pct_resolved"),
    )


@report
def reference_formats(d: Directory) -> DataFrame:
    return integrity.reference_formats(
        [
            integrity.reference_edges("organizations", d["organizations"], {"partOf": "parent_ref"}),
            integrity.reference_edges(
                "practitioner_roles",
                d["practitioner_roles"],
                {"practitioner": "practitioner_ref", "organization": "organization_ref"},
            ),
            integrity.reference_edges(
                "organization_affiliations",
                d["organization_affiliations"],
                {"organization": "organization_ref", "participatingOrganization": "participating_ref"},
            ),
            integrity.reference_edges("locations", d["locations"], {"managingOrganization": "managing_ref"}),
            integrity.reference_edges("endpoints", d["endpoints"], {"managingOrganization": "managing_ref"}),
        ]
    )


# --- identifiers ---------------------------------------------------------------------------


def _npi(d: Directory, resource: str, systems: tuple[str, ...]) -> DataFrame:
    return coverage.identifier_coverage(d[resource], systems, "has_npi", "pct_has_npi")


@report
def practitioner_npi_single_system(d: Directory) -> DataFrame:
    return _npi(d, "practitioners", (NPI_SYSTEM_A,))


@report
def organization_npi_single_system(d: Directory) -> DataFrame:
    return _npi(d, "organizations", (NPI_SYSTEM_A,))


@report
def practitioner_npi(d: Directory) -> DataFrame:
    return _npi(d, "practitioners", NPI_SYSTEMS)


@report
def organization_npi(d: Directory) -> DataFrame:
    return _npi(d, "organizations", NPI_SYSTEMS)


def _identifier_systems(d: Directory, resource: str) -> DataFrame:
    return counts.value_counts(d[resource], {"identifier_system": "element.system"}, "identifiers")


@report
def practitioner_identifier_systems(d: Directory) -> DataFrame:
    return _identifier_systems(d, "practitioners")


@report
def organization_identifier_systems(d: Directory) -> DataFrame:
    return _identifier_systems(d, "organizations")


@report
def role_identifier_systems(d: Directory) -> DataFrame:
    return _identifier_systems(d, "practitioner_roles")


@report
def role_identifier_coverage(d: Directory) -> DataFrame:
    return coverage.flag_report(
        d["practitioner_roles"],
        counts={"has_identifier": "has_identifier"},
        shares={"pct_has_identifier": "has_identifier"},
    )


@report
def organization_identifier_sample(d: Directory) -> DataFrame:
    """Identifiers of three organizations of dataset-a that carry some, but no NPI of its system."""
    organizations = d["organizations"].filter(
        (F.col("source_dataset") == "dataset-a")
        & F.col("has_identifier")
        & ~has_value(F.col("identifiers").getField("system"), NPI_SYSTEM_A)
    )
    return sampling.sample_records(organizations, [F.col("identifier_json").alias("identifier")], 3)


@report
def identifier_fragmentation(d: Directory) -> DataFrame:
    return overlap.identifier_fragmentation(d["organizations"], NPI_SYSTEMS)


@report
def identifier_quality(d: Directory) -> DataFrame:
    return anomaly.identifier_quality(d["organizations"], SSN_SYSTEM)


# --- field completeness --------------------------------------------------------------------


def _complete(d: Directory, resource: str, **fields: str) -> DataFrame:
    """Percentage columns named ``pct_<key>`` for the presence flags ``has_<value>``."""
    return coverage.field_completeness(d[resource], {f"pct_{n}": f"has_{m}" for n, m in fields.items()})


@report
def practitioner_completeness(d: Directory) -> DataFrame:
    return _complete(
        d, "practitioners", identifier="identifier", name="name", gender="gender", qualification="qualification",
        communication="communication", active="active", photo="photo",
    )


@report
def practitioner_core_completeness(d: Directory) -> DataFrame:
    return _complete(
        d, "practitioners", active="active", name="name", gender="gender", any_identifier="identifier",
        telecom="telecom", address="address", qualification="qualification", communication="communication",
    )


@report
def practitioner_completeness_brief(d: Directory) -> DataFrame:
    return _complete(
        d, "practitioners", name="name", gender="gender", qualification="qualification",
        communication="communication", active="active",
    )


@report
def organization_completeness(d: Directory) -> DataFrame:
    return _complete(
        d, "organizations", identifier="identifier", active="active", type="type", name="name", alias="alias",
        telecom="telecom", address="address", contact="contact", endpoint_ref="endpoint",
    )


@report
def organization_completeness_brief(d: Directory) -> DataFrame:
    return _complete(
        d, "organizations", active="active", type="type", name="name", telecom="telecom", address="address",
        endpoint_ref="endpoint",
    )


@report
def organization_parent_presence(d: Directory) -> DataFrame:
    return coverage.flag_report(
        d["organizations"], counts={"has_part_of": "has_partOf"}, shares={"pct_has_part_of": "has_partOf"}
    )


@report
def role_completeness(d: Directory) -> DataFrame:
    return _complete(
        d, "practitioner_roles", active="active", practitioner="practitioner", organization="organization",
        code="code", specialty="specialty", location="location", endpoint="endpoint",
        available_time="availableTime", not_available="notAvailable",
    )


@report
def role_core_completeness(d: Directory) -> DataFrame:
    return _complete(
        d, "practitioner_roles", active="active", practitioner="practitioner", organization="organization",
        role_code="code", specialty="specialty", location="location", telecom="telecom", endpoint="endpoint",
        available_time="availableTime", not_available="notAvailable",
    )


@report
def role_completeness_brief(d: Directory) -> DataFrame:
    return _complete(
        d, "practitioner_roles", active="active", practitioner="practitioner", organization="organization",
        specialty="specialty", location="location", endpoint="endpoint", available_time="availableTime",
    )


@report
def affiliation_completeness(d: Directory) -> DataFrame:
    return _complete(
        d, "organization_affiliations", active="active", organization="organization",
        participating_org="participatingOrganization", code="code", specialty="specialty", location="location",
        endpoint="endpoint",
    )


@report
def location_completeness(d: Directory) -> DataFrame:
    return _complete(
        d, "locations", status="status", name="name", type="type", telecom="telecom", address="address",
        position="position", managing_org="managingOrganization", hours_of_operation="hoursOfOperation",
    )


@report
def endpoint_completeness(d: Directory) -> DataFrame:
    return _complete(
        d, "endpoints", status="status", connection_type="connectionType", name="name",
        managing_org="managingOrganization", payload_type="payloadType", address="address",
    )


@report
def endpoint_payload_coverage(d: Directory) -> DataFrame:
    return coverage.flag_report(
        d["endpoints"],
        counts={"has_payload_type": "has_payloadType", "has_address": "has_address"},
        shares={"pct_payload_type": "has_payloadType", "pct_address": "has_address"},
    ).select("source_dataset", "total", "has_payload_type", "pct_payload_type", "has_address", "pct_address")


@report
def role_availability(d: Directory) -> DataFrame:
    return coverage.flag_report(
        d["practitioner_roles"],
        counts={"has_available_time": "has_availableTime", "has_not_available": "has_notAvailable"},
        shares={"pct_available_time": "has_availableTime", "pct_not_available": "has_notAvailable"},
    )


@report
def role_contact_invariant(d: Directory) -> DataFrame:
    return coverage.either_invariant(
        d["practitioner_roles"],
        "has_telecom",
        "has_endpoint",
        {
            "first": "has_telecom",
            "second": "has_endpoint",
            "either": "has_telecom_or_endpoint",
            "neither": "missing_both",
            "share_neither": "pct_missing_both",
        },
    )


# --- extensions ----------------------------------------------------------------------------


@report
def role_new_patients_extension(d: Directory) -> DataFrame:
    return coverage.extension_coverage(
        d["practitioner_roles"], "newpatients", "has_new_patients_ext", "pct_has_new_patients", "total",
        "only_rows_with_extension",
    )


@report
def role_network_extension(d: Directory) -> DataFrame:
    return coverage.extension_coverage(
        d["practitioner_roles"], "network", "has_network_ext", "pct_has_network"
    )


@report
def practitioner_qualification_extension(d: Directory) -> DataFrame:
    return coverage.extension_coverage(
        d["practitioners"], "qualification", "has_qualification_ext", "pct_has_qualification_ext"
    )


@report
def location_accessibility_extension(d: Directory) -> DataFrame:
    return coverage.extension_coverage(
        d["locations"], "accessibility", "has_accessibility_ext", "pct_has_accessibility"
    )


@report
def practitioner_extension_census(d: Directory) -> DataFrame:
    return coverage.extension_census(
        d["practitioners"],
        {
            "has_endpoint_ref_ext": "endpoint",
            "has_verification_status": "verification-status",
            "has_comm_proficiency": "communication-proficiency",
            "has_rating": "rating",
            "has_accessibility": "accessibility",
        },
    )


@report
def role_extension_census(d: Directory) -> DataFrame:
    return coverage.extension_census(
        d["practitioner_roles"],
        {
            "has_new_patients": "newpatients",
            "has_network": "network",
            "has_verification_status": "verification-status",
            "has_qualification_ext": "qualification",
            "has_rating": "rating",
        },
    )


def _extension_urls(d: Directory, resource: str, limit: int | None = None) -> DataFrame:
    return counts.value_counts(d[resource], {"extension_url": "element"}, "extension_urls", limit)


@report
def practitioner_extension_urls_top(d: Directory) -> DataFrame:
    return _extension_urls(d, "practitioners", 50)


@report
def practitioner_extension_urls(d: Directory) -> DataFrame:
    return _extension_urls(d, "practitioners")


@report
def role_extension_urls(d: Directory) -> DataFrame:
    return _extension_urls(d, "practitioner_roles")


@report
def profile_census(d: Directory) -> DataFrame:
    return counts.value_counts(d["organizations"], {"profile": "element"}, "profiles")


# --- codings -------------------------------------------------------------------------------


def _codings(
    d: Directory, resource: str, codings: str, limit: int | None = None, per_dataset: int | None = None
) -> DataFrame:
    return counts.value_counts(d[resource], CODING_FIELDS, codings, limit, per_dataset)


@report
def role_specialty_coding(d: Directory) -> DataFrame:
    return coverage.coding_coverage(
        d["practitioner_roles"], "specialty_codings", SPECIALTY_SYSTEM, "has_nucc_specialty", "pct_nucc_coded",
        "has_specialty", "total_with_specialty", "present",
    )


@report
def role_specialty_coverage(d: Directory) -> DataFrame:
    return coverage.coding_coverage(
        d["practitioner_roles"], "specialty_codings", SPECIALTY_SYSTEM, "has_nucc_specialty", "pct_nucc_specialty",
        "has_specialty", has_present="has_specialty", share_present="pct_has_specialty",
    ).select(
        "source_dataset", "total", "has_specialty", "pct_has_specialty", "has_nucc_specialty", "pct_nucc_specialty"
    )


@report
def role_specialty_codes_top30(d: Directory) -> DataFrame:
    return _codings(d, "practitioner_roles", "specialty_codings", 30)


@report
def role_specialty_codes(d: Directory) -> DataFrame:
    return _codings(d, "practitioner_roles", "specialty_codings", 40)


@report
def role_specialty_codes_per_dataset(d: Directory) -> DataFrame:
    return _codings(d, "practitioner_roles", "specialty_codings", per_dataset=20)


@report
def role_codes(d: Directory) -> DataFrame:
    return _codings(d, "practitioner_roles", "code_codings", 30)


@report
def organization_type_codes(d: Directory) -> DataFrame:
    return _codings(d, "organizations", "type_codings", 30)


@report
def affiliation_codes(d: Directory) -> DataFrame:
    return _codings(d, "organization_affiliations", "code_codings", 30)


@report
def qualification_codes(d: Directory) -> DataFrame:
    return _codings(d, "practitioners", "qualification_codings", 40)


@report
def qualification_code_systems(d: Directory) -> DataFrame:
    return counts.value_counts(d["practitioners"], {"code_system": "element.system"}, "qualification_codings")


@report
def qualification_depth(d: Directory) -> DataFrame:
    return coverage.nested_presence(
        d["practitioners"],
        {
            "has_qualification": "has_qualification",
            "has_qual_code": "has_qualification_code",
            "has_qual_issuer": "has_qualification_issuer",
            "has_qual_period": "has_qualification_period",
        },
        "qualification_extension_urls",
        "qualification",
        "has_qual_extension",
    )


@report
def qualification_counts(d: Directory) -> DataFrame:
    return coverage.array_length_stats(
        d["practitioners"], "qualification_size", "has_qualification",
        ("avg_qualifications_per_practitioner", "max_qualifications", "min_qualifications"),
    )


@report
def specialty_counts(d: Directory) -> DataFrame:
    return coverage.array_length_stats(
        d["practitioner_roles"], "specialty_size", "has_specialty",
        ("avg_specialties_per_role", "max_specialties", "min_specialties"),
    )


@report
def availability_weekdays(d: Directory) -> DataFrame:
    return counts.value_counts(
        d["practitioner_roles"], {"day_of_week": "element"}, "weekdays_json", order="value"
    )


@report
def availability_weekdays_plain(d: Directory) -> DataFrame:
    """The same without the quotes of the JSON form."""
    return counts.value_counts(
        d["practitioner_roles"], {"day_of_week": "element"}, "weekdays", order="value"
    )


@report
def endpoint_connection_types(d: Directory) -> DataFrame:
    return counts.value_counts(
        d["endpoints"],
        {"connection_type_system": "connection_system", "connection_type_code": "connection_code"},
        present="has_connectionType",
    )


@report
def endpoint_status(d: Directory) -> DataFrame:
    return counts.value_counts(d["endpoints"], {"status": "status"})


# --- linkage -------------------------------------------------------------------------------


def _practitioner_id() -> Column:
    return last_segment(F.col("practitioner_ref"))


@report
def practitioner_role_coverage(d: Directory) -> DataFrame:
    return linkage.linked_coverage(d["practitioners"], _has_npi(), d["practitioner_roles"], _practitioner_id())


@report
def directory_completeness(d: Directory) -> DataFrame:
    urls = F.col("extension_urls")
    return linkage.directory_completeness(
        d["practitioners"],
        {
            "npi": _has_npi(),
            "active": F.col("has_active"),
            "name": F.col("has_name"),
            "gender": F.col("has_gender"),
            "qualification": F.col("has_qualification"),
        },
        d["practitioner_roles"],
        _practitioner_id(),
        {
            "specialty": F.col("has_specialty"),
            "nucc_specialty": has_value(F.col("specialty_codings").getField("system"), SPECIALTY_SYSTEM),
            "location_or_org": F.col("has_location") | F.col("has_organization"),
            "contact": F.col("has_telecom") | F.col("has_endpoint"),
            "availability": F.col("has_availableTime"),
            "new_patients": has_substring(urls, "newpatients"),
            "network": has_substring(urls, "network"),
        },
        {
            "pct_npi": "npi",
            "pct_active": "active",
            "pct_name": "name",
            "pct_gender": "gender",
            "pct_qualification": "qualification",
            "pct_with_any_role": "is_linked",
            "pct_with_specialty_via_role": "specialty",
            "pct_with_nucc_specialty": "nucc_specialty",
            "pct_with_location_or_org": "location_or_org",
            "pct_with_contact": "contact",
            "pct_with_availability": "availability",
            "pct_with_new_patients": "new_patients",
            "pct_with_network": "network",
        },
        ["npi", "name", "active", "nucc_specialty", "location_or_org", "contact"],
    )


@report
def roles_per_practitioner(d: Directory) -> DataFrame:
    return linkage.fanout_distribution(d["practitioner_roles"], "has_practitioner", _practitioner_id())


# --- hierarchy, anomalies ------------------------------------------------------------------


@report
def organization_hierarchy_depth(d: Directory) -> DataFrame:
    return hierarchy.hierarchy_depth(d["organizations"])


@report
def organization_hierarchy_depth_resolved(d: Directory) -> DataFrame:
    """The same with absolute references followed as well."""
    return hierarchy.hierarchy_depth(d["organizations"], parse="last", with_limit=True)


@report
def organization_oversized_arrays(d: Directory) -> DataFrame:
    return anomaly.oversized_arrays(
        d["organizations"],
        {
            "address_count": "address_size",
            "telecom_count": "telecom_size",
            "identifier_count": "identifier_size",
            "contact_count": "contact_size",
        },
        ["source_dataset", "fhir_id", "name"],
    )


@report
def shell_records(d: Directory) -> DataFrame:
    return anomaly.shell_records(d["organizations"], ["has_telecom", "has_address", "has_type", "has_endpoint"])


@report
def malformed_arrays(d: Directory) -> DataFrame:
    """Locations may hold an object for an address; here it shows as not being an array."""
    return anomaly.malformed_arrays(
        d.documents("locations"), {"address_not_array": "$.address", "telecom_not_array": "$.telecom"}
    )


# --- samples -------------------------------------------------------------------------------


@report
def practitioner_sample(d: Directory) -> DataFrame:
    sample = sampling.sample_records(
        d["practitioners"].filter("has_qualification"),
        [
            "source_dataset",
            "fhir_id",
            "active",
            F.col("name_text").alias("name"),
            "gender",
            _first_npi().alias("npi"),
            F.col("qualification_size").cast("long").alias("qual_count"),
            F.col("extension_size").cast("long").alias("ext_count"),
        ],
        10,
    )
    return sampling.with_link_count(sample, d["practitioner_roles"], _practitioner_id(), "role_count")


def _role_sample_columns() -> list[Column | str]:
    return [
        "source_dataset",
        "fhir_id",
        "active",
        "practitioner_ref",
        "organization_ref",
        F.col("first_specialty_code").alias("primary_specialty_code"),
        F.col("first_specialty_display").alias("primary_specialty_display"),
        F.col("location_size").cast("long").alias("location_count"),
        F.col("has_availableTime").alias("has_available_time"),
        F.col("extension_size").cast("long").alias("ext_count"),
    ]


@report
def role_sample(d: Directory) -> DataFrame:
    return sampling.sample_records(d["practitioner_roles"], _role_sample_columns(), 10)


@report
def role_sample_per_dataset(d: Directory) -> DataFrame:
    return sampling.sample_records(d["practitioner_roles"], _role_sample_columns(), 10, per_dataset=True)


# --- merging -------------------------------------------------------------------------------

DIRECTORY_ATTRIBUTES = ["telecom_json", "address_json", "type_json", "endpoint_json"]


@report
def organization_consolidation(d: Directory) -> DataFrame:
    return merging.consolidate(d["organizations"], NPI_SYSTEMS, ["name", *DIRECTORY_ATTRIBUTES])


@report
def organization_reconciliation(d: Directory) -> DataFrame:
    return merging.reconcile(d["organizations"], NPI_SYSTEMS, "name", DIRECTORY_ATTRIBUTES)
