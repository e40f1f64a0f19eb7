"""Typed columns per resource, read once from the documents.

``features`` is a lazy projection. A report over it extracts only the members it uses, because
Catalyst prunes the others. Written with ``sources.store.write_features`` the same columns
become a narrow Parquet table, so that later reports never parse a document again.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirlens.functions.variant import CODING, array, codings, flat, node, text


class Feature(NamedTuple):
    """A column read from one top-level member of a document."""

    member: str
    extract: Callable[[Column], Column]


IDENTIFIER = "struct<system:string,value:string>"
REFERENCE = "struct<reference:string>"


def _at(path: str, extract: Callable[[Column, str], Column]) -> Feature:
    """A feature at a path such as ``$.member.inner`` or ``$.member[0].inner``."""
    member = path.removeprefix("$.").split(".")[0].split("[")[0]
    return Feature(member, lambda doc: extract(doc, path))


def _has(path: str) -> Feature:
    return _at(path, node)


def _has_text(path: str) -> Feature:
    return _at(path, lambda doc, p: text(doc, p).isNotNull())


def _text(path: str) -> Feature:
    return _at(path, text)


def _size(path: str) -> Feature:
    return _at(path, lambda doc, p: F.size(array(doc, p)))


def _codings(path: str) -> Feature:
    return _at(path, codings)


def _array(path: str, element: str, *fields: str) -> Feature:
    """An array of structs, or of one of their fields."""

    def extract(doc: Column, p: str) -> Column:
        found = array(doc, p, element)
        for field in fields:
            found = found.getField(field)
        return found

    return _at(path, extract)


def _flat(path: str, element: str, *fields: str) -> Feature:
    """The inner arrays of an array, as one array."""
    nested = _array(path, element, *fields)
    return Feature(nested.member, lambda doc: flat(nested.extract(doc)))


def _then(feature: Feature, change: Callable[[Column], Column]) -> Feature:
    return Feature(feature.member, lambda doc: change(feature.extract(doc)))


def _any_member(path: str, member: str) -> Feature:
    return _at(
        path, lambda doc, p: F.coalesce(F.exists(array(doc, p), lambda e: node(e, f"$.{member}")), F.lit(False))
    )


def _presence(nodes: tuple[str, ...], texts: tuple[str, ...] = ()) -> dict[str, Feature]:
    return {f"has_{m}": _has(f"$.{m}") for m in nodes} | {f"has_{m}": _has_text(f"$.{m}") for m in texts}


COMMON: dict[str, Feature] = {
    "last_updated": _text("$.meta.lastUpdated"),
    "profiles": _array("$.meta.profile", "string"),
    "has_identifier": _has("$.identifier"),
    "identifiers": _array("$.identifier", IDENTIFIER),
    "identifier_size": _size("$.identifier"),
    "has_extension": _has("$.extension"),
    "extension_urls": _array("$.extension", "struct<url:string>", "url"),
    "extension_size": _size("$.extension"),
}

SPECIFIC: dict[str, dict[str, Feature]] = {
    "practitioners": _presence(
        nodes=("name", "qualification", "communication", "photo", "telecom", "address"),
        texts=("active", "gender"),
    )
    | {
        "active": _text("$.active"),
        "gender": _text("$.gender"),
        "name_text": _text("$.name[0].text"),
        "qualification_size": _size("$.qualification"),
        "has_qualification_code": _any_member("$.qualification", "code"),
        "has_qualification_issuer": _any_member("$.qualification", "issuer"),
        "has_qualification_period": _any_member("$.qualification", "period"),
        "qualification_extension_urls": _then(
            _flat("$.qualification", "struct<extension:array<struct<url:string>>>", "extension"),
            lambda extensions: extensions.getField("url"),
        ),
        "qualification_codings": _flat(
            "$.qualification", f"struct<code:struct<coding:array<{CODING}>>>", "code", "coding"
        ),
    },
    "practitioner_roles": _presence(
        nodes=(
            "practitioner", "organization", "code", "specialty", "location", "endpoint",
            "availableTime", "notAvailable", "telecom",
        ),
        texts=("active",),
    )
    | {
        "active": _text("$.active"),
        "practitioner_ref": _text("$.practitioner.reference"),
        "organization_ref": _text("$.organization.reference"),
        "location_refs": _array("$.location", REFERENCE, "reference"),
        "location_size": _size("$.location"),
        "code_codings": _codings("$.code"),
        "specialty_codings": _codings("$.specialty"),
        "specialty_size": _size("$.specialty"),
        "first_specialty_code": _text("$.specialty[0].coding[0].code"),
        "first_specialty_display": _text("$.specialty[0].coding[0].display"),
        "weekdays": _flat("$.availableTime", "struct<daysOfWeek:array<string>>", "daysOfWeek"),
        # Elements keep their JSON form, so a weekday reads "mon" with its quotes.
        "weekdays_json": _then(
            _flat("$.availableTime", "struct<daysOfWeek:array<variant>>", "daysOfWeek"),
            lambda days: F.transform(days, lambda day: F.to_json(day)),
        ),
    },
    "organizations": _presence(
        nodes=("type", "alias", "telecom", "address", "contact", "endpoint", "partOf"),
        texts=("active", "name"),
    )
    | {
        "identifier_json": _text("$.identifier"),
        "identifier_elements": _then(
            _array("$.identifier", "variant"), lambda elements: F.transform(elements, lambda e: F.to_json(e))
        ),
        "name": _text("$.name"),
        "type_codings": _codings("$.type"),
        "parent_ref": _text("$.partOf.reference"),
        "address_size": _size("$.address"),
        "telecom_size": _size("$.telecom"),
        "contact_size": _size("$.contact"),
        "type_json": _text("$.type"),
        "telecom_json": _text("$.telecom"),
        "address_json": _text("$.address"),
        "endpoint_json": _text("$.endpoint"),
    },
    "organization_affiliations": _presence(
        nodes=(
            "organization", "participatingOrganization", "code", "specialty", "location", "endpoint",
        ),
        texts=("active",),
    )
    | {
        "organization_ref": _text("$.organization.reference"),
        "participating_ref": _text("$.participatingOrganization.reference"),
        "code_codings": _codings("$.code"),
    },
    "locations": _presence(
        nodes=("type", "telecom", "address", "position", "managingOrganization", "hoursOfOperation"),
        texts=("status", "name"),
    )
    | {"managing_ref": _text("$.managingOrganization.reference")},
    "endpoints": _presence(
        nodes=("connectionType", "managingOrganization", "payloadType"),
        texts=("status", "name", "address"),
    )
    | {
        "status": _text("$.status"),
        "connection_system": _text("$.connectionType.system"),
        "connection_code": _text("$.connectionType.code"),
        "managing_ref": _text("$.managingOrganization.reference"),
    },
}


def resource_features(resource: str) -> dict[str, Feature]:
    return COMMON | SPECIFIC[resource]


def features(documents: DataFrame, resource: str) -> DataFrame:
    """Key, byte size and one typed column per member the reports use."""
    return documents.select(
        "source_dataset",
        "fhir_id",
        F.octet_length("raw_json").cast("long").alias("json_bytes"),
        *[f.extract(F.col("doc")).alias(name) for name, f in resource_features(resource).items()],
    )
