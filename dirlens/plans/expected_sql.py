"""SQL that recomputes each report from the columns of the test tables.

No JSON is read here. Every resource is a view over its source table that applies the rules of
``sources.derived`` to scalar columns and lists; the reports are then plain SQL over these views.
The text is for DuckDB and serves as the independent side of the correctness check.
"""

from __future__ import annotations

from dirlens.schema import NPI_SYSTEM_A, NPI_SYSTEM_B, SPECIALTY_SYSTEM, SSN_SYSTEM
from dirlens.sources.derived import BASE, EXAMPLE, IN_DATASET_B

NPI_ANY = f"('{NPI_SYSTEM_A}', '{NPI_SYSTEM_B}')"


def _both(resource: str, source: str) -> str:
    return (
        f"(SELECT 'dataset-a' AS source_dataset, true AS a, * FROM {source} "
        f"UNION ALL SELECT 'dataset-b', false, * FROM {source} WHERE {IN_DATASET_B[resource]})"
    )


def _ref(kind: str, name: str) -> str:
    return f"(CASE WHEN a THEN '' ELSE '{BASE}' END) || '{kind}/' || {name}"


def _ident(system: str, value: str) -> str:
    return f"{{'system': {system}, 'value': {value}}}"


def _coding(system: str, code: str, display: str) -> str:
    return f"{{'system': {system}, 'code': {code}, 'display': {display}}}"


_ORG_NPI = _ident(f"'{NPI_SYSTEM_A}'", "(1000000000 + s_suppkey // 2)::varchar")
_PRAC_VALUE = "(2000000000 + c_custkey)::varchar"
_NUCC = _coding(f"'{SPECIALTY_SYSTEM}'", "o_orderpriority", "substr(o_orderpriority, 3)")
_OTHER = _coding(f"'{EXAMPLE}/specialty'", "o_orderpriority", "substr(o_orderpriority, 3)")

VIEWS = {
    "org": f"""
SELECT source_dataset, a, s_suppkey AS k, 'org-' || s_suppkey AS fhir_id,
  CASE WHEN NOT a OR s_acctbal >= 0 THEN s_name END AS name,
  CASE WHEN a THEN '2024-' || lpad((1 + s_nationkey % 12)::varchar, 2, '0') || '-15T08:00:00Z' END AS last_updated,
  '{EXAMPLE}/profile/' || CASE WHEN a THEN 'directory-organization' ELSE 'core-organization' END AS profile,
  CASE WHEN NOT a THEN [{_ident(f"'{NPI_SYSTEM_B}'", "(1000000000 + s_suppkey)::varchar")}]
       WHEN s_suppkey % 6 = 1 THEN [{_ident(f"'{SSN_SYSTEM}'", "'00000000-0000-4000-8000-' || lpad(s_suppkey::varchar, 12, '0')")}]
       WHEN s_suppkey % 6 = 3 THEN [{_ORG_NPI}, {_ORG_NPI}]
       WHEN s_suppkey % 6 = 4 THEN [{_ORG_NPI}, {_ident('NULL', "'legacy-' || s_suppkey")}]
       WHEN s_suppkey % 6 IN (2, 5) THEN [{_ORG_NPI}] END AS identifiers,
  a AND s_suppkey % 4 = 1 AS has_type, a AND s_suppkey % 9 = 0 AS has_alias, a AND s_suppkey % 5 < 2 AS has_telecom,
  a AND s_suppkey % 7 = 0 AS has_contact, a AND s_suppkey % 8 = 0 AS has_endpoint,
  CASE WHEN a THEN CASE WHEN s_suppkey % 50 = 7 THEN 150 ELSE 1 + s_suppkey % 3 END END AS n_address,
  CASE WHEN a AND s_suppkey % 7 = 0 THEN CASE WHEN s_suppkey % 50 = 21 THEN 101 ELSE 1 END END AS n_contact,
  s_nationkey AS nk, s_suppkey > 0 AS has_parent,
  CASE WHEN s_suppkey > 0 THEN {_ref('Organization', "(CASE WHEN s_suppkey % 17 = 0 THEN 'org-x' ELSE 'org-' END) || (s_suppkey // 3)")} END AS parent_ref
FROM {_both('organizations', 'supplier')}""",
    "prac": f"""
SELECT source_dataset, a, c_custkey AS k, 'prac-' || (CASE WHEN a THEN 'a-' ELSE 'b-' END) || c_custkey AS fhir_id, c_name,
  CASE WHEN a THEN '2023-' || lpad((1 + c_custkey % 12)::varchar, 2, '0') || '-' || lpad((1 + c_custkey % 28)::varchar, 2, '0') || 'T00:00:00Z' END AS last_updated,
  CASE WHEN a AND c_custkey % 10 <> 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END END AS gender,
  CASE WHEN NOT a AND c_custkey % 13 = 0 THEN [{_ident(f"'{NPI_SYSTEM_B}'", 'NULL')}]
       WHEN NOT a THEN [{_ident(f"'{NPI_SYSTEM_B}'", _PRAC_VALUE)}]
       WHEN c_nationkey = 0 THEN [{_ident(f"'{EXAMPLE}/license'", "'L' || c_custkey")}]
       WHEN c_custkey % 7 = 0 THEN [{_ident(f"'{NPI_SYSTEM_A}'", _PRAC_VALUE)}, {_ident(f"'{NPI_SYSTEM_B}'", _PRAC_VALUE)}]
       ELSE [{_ident(f"'{NPI_SYSTEM_A}'", _PRAC_VALUE)}] END AS identifiers,
  c_custkey % 4 AS n_qual, c_custkey % 4 > 0 AS has_qualification,
  CASE WHEN a AND c_custkey % 15 = 0 THEN ['endpoint-reference', 'verification-status']
       WHEN a AND c_custkey % 3 = 0 THEN ['endpoint-reference']
       WHEN a AND c_custkey % 5 = 0 THEN ['base-ext-qualification'] END AS ext,
  c_mktsegment = 'MACHINERY' AS has_communication, a OR c_custkey % 3 <> 0 AS has_telecom,
  a OR c_mktsegment IN ('AUTOMOBILE', 'FURNITURE') AS has_address, a AND c_custkey % 20 = 0 AS has_photo
FROM {_both('practitioners', 'customer')}""",
    "role": f"""
SELECT source_dataset, a, o_orderkey AS k, 'role-' || (CASE WHEN a THEN 'a-' ELSE 'b-' END) || o_orderkey AS fhir_id,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS last_updated, o_orderdate,
  o_orderkey % 4 = 1 AS has_identifier, o_orderkey % 50 <> 0 AS has_practitioner,
  CASE WHEN o_orderkey % 50 > 1 THEN {_ref('Practitioner', "'prac-' || (CASE WHEN a THEN 'a-' ELSE 'b-' END) || o_custkey")} END AS practitioner_ref,
  o_orderkey % 40 <> 7 AS has_organization,
  CASE WHEN o_orderkey % 40 <> 7 THEN {_ref('Organization', "'org-' || CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey % 130 END")} END AS organization_ref,
  o_orderkey % 25 <> 4 AS has_location,
  CASE WHEN o_orderkey % 25 = 4 THEN NULL
       WHEN o_orderkey % 3 = 0 THEN ['loc-x' || o_custkey]
       ELSE list_transform(range(0, 1 + o_orderkey % 3), lambda i: 'loc-' || (o_custkey + i)) END AS location_ids,
  o_orderstatus AS status, o_orderpriority AS priority,
  substr(o_orderpriority, 1, 1) <> '5' AS has_specialty, substr(o_orderpriority, 1, 1) IN ('1', '2') AS has_nucc,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN [{_NUCC}, {_OTHER}] WHEN '2' THEN [{_NUCC}] WHEN '5' THEN NULL ELSE [{_OTHER}] END AS specialties,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1 WHEN '2' THEN 1 WHEN '5' THEN NULL ELSE 2 END AS n_specialty,
  o_orderstatus = 'O' AS has_telecom, o_orderstatus = 'F' AS has_endpoint,
  o_orderkey % 3 = 0 OR (a AND o_orderkey % 3 = 1) AS has_available,
  CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN ['"mon"', '"wed"'] ELSE ['"tue"'] END END AS days,
  o_orderkey % 11 = 0 AS has_not_available,
  CASE WHEN NOT a THEN NULL WHEN o_orderkey % 12 = 0 THEN ['newpatients', 'network'] WHEN o_orderkey % 4 = 0 THEN ['newpatients']
       WHEN o_orderkey % 6 = 0 THEN ['network'] WHEN o_orderkey % 6 = 1 THEN ['rating'] END AS ext
FROM {_both('practitioner_roles', 'orders')}""",
    "loc": f"""
SELECT source_dataset, a, p_partkey AS k, 'loc-' || p_partkey AS fhir_id, p_partkey % 15 <> 0 AS has_name, a AND p_partkey % 2 = 0 AS has_telecom,
  a OR p_partkey % 2 = 0 AS has_address, p_size > 10 AS has_position, p_partkey % 9 <> 0 AS has_managing,
  CASE WHEN p_partkey % 9 <> 0 THEN {_ref('Organization', "'org-' || (p_partkey % 130)")} END AS managing_ref,
  p_partkey % 7 = 0 AS has_hours, a AND p_partkey % 10 IN (0, 1) AS has_extension, a AND p_partkey % 10 = 0 AS has_accessibility
FROM {_both('locations', 'part')}""",
    "ep": f"""
SELECT source_dataset, a, event_id AS k, 'ep-' || event_id AS fhir_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS last_updated,
  CASE WHEN event_type <> 'error' THEN event_type END AS status, event_type, event_type <> 'signup' AS has_connection,
  event_id % 3 = 0 AS has_name, event_id % 9 <> 0 AS has_managing,
  CASE WHEN event_id % 9 <> 0 THEN {_ref('Organization', "'org-' || (user_id % 110)")} END AS managing_ref,
  event_id % 2 = 0 AS has_payload, value >= 50 AS has_address
FROM {_both('endpoints', 'events')}""",
    "aff_src": "SELECT l_orderkey, min(l_suppkey) AS s, min(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey",
    "aff": f"""
SELECT source_dataset, a, l_orderkey AS k, flag, {_ref('Organization', "'org-' || s")} AS organization_ref, l_orderkey % 10 <> 3 AS has_participating,
  CASE WHEN l_orderkey % 10 <> 3 THEN {_ref('Organization', "'org-' || (s + 7)")} END AS participating_ref,
  l_orderkey % 6 = 0 AS has_specialty, l_orderkey % 4 = 0 AS has_location, l_orderkey % 10 = 0 AS has_endpoint
FROM {_both('organization_affiliations', 'aff_src')}""",
    "runs": """
SELECT resource_type, source_dataset, resource_type || '_' || yr AS source_file, max(o_orderdate) AS run_at,
  CASE WHEN source_dataset = 'dataset-a' THEN 'zst' ELSE 'gz' END AS compression,
  (sum(o_custkey) * 1000)::bigint AS compressed_size_bytes, count(*) * 7 AS download_ms,
  (sum(o_custkey) // 100)::bigint AS process_ms, count(*) AS record_count, count(*) FILTER (WHERE o_orderstatus = 'P') AS error_count
FROM (SELECT o_orderpriority AS resource_type, CASE WHEN o_totalprice >= 250000 THEN 'dataset-b' ELSE 'dataset-a' END AS source_dataset,
        year(o_orderdate) AS yr, o_orderdate, o_custkey, o_orderstatus FROM orders)
GROUP BY resource_type, source_dataset, yr""",
}

NEEDS = {"aff": ["aff_src"]}


def _with(views: str, select: str, more: str = "", recursive: bool = False) -> str:
    names: list[str] = []
    for view in views.split():
        names += [*NEEDS.get(view, []), view]
    parts = [f"{name} AS ({VIEWS[name].strip()})" for name in names]
    if more:
        parts.append(more)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + select.strip()


def _n(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


def _pct(part: str, whole: str = "count(*)") -> str:
    return f"round(100.0 * {part} / nullif({whole}, 0), 1)"


def _by_dataset(view: str, columns: dict[str, str], where: str = "true") -> str:
    listed = ", ".join(f"{sql} AS {name}" for name, sql in columns.items())
    return _with(view, f"SELECT source_dataset, {listed} FROM {view} WHERE {where} GROUP BY source_dataset")


def _complete(view: str, **fields: str) -> str:
    return _by_dataset(view, {"total": "count(*)"} | {f"pct_{n}": _pct(_n(c)) for n, c in fields.items()})


def _with_system(systems: str) -> str:
    return f"len(list_filter(coalesce(identifiers, []), lambda e: e.system IN {systems})) > 0"


def _npi(view: str, systems: str) -> str:
    found = _n(_with_system(systems))
    return _by_dataset(
        view,
        {
            "total": "count(*)",
            "has_any_identifier": _n("identifiers IS NOT NULL"),
            "has_npi": found,
            "pct_has_npi": _pct(found),
        },
    )


def _elements(view: str, array: str, fields: dict[str, str], limit: int | None = None) -> str:
    listed = ", ".join(f"{sql} AS {name}" for name, sql in fields.items())
    tail = ""
    if limit is not None:
        ties = ", ".join(f"{name} ASC NULLS LAST" for name in fields)
        tail = f" ORDER BY source_dataset, occurrences DESC, {ties} LIMIT {limit}"
    return _with(
        view,
        f"SELECT source_dataset, {listed}, count(*) AS occurrences "
        f"FROM (SELECT source_dataset, unnest({array}) AS e FROM {view}) "
        f"GROUP BY source_dataset, {', '.join(fields)}{tail}",
    )


_CODING = {"system": "e.system", "code": "e.code", "display": "e.display"}


def _single_coding(view: str, system: str, code: str, display: str, where: str = "true") -> str:
    return _with(
        view,
        f"SELECT source_dataset, {system} AS system, {code} AS code, {display} AS display, count(*) AS occurrences "
        f"FROM {view} WHERE {where} GROUP BY source_dataset, system, code, display "
        "ORDER BY source_dataset, occurrences DESC, system, code, display LIMIT 30",
    )


def _resolution(views: str, source: str, ref: str, has: str, target: str, part: int, columns: dict[str, str]) -> str:
    """``columns`` may use n_total, n_missing, n_present, n_resolved."""
    listed = ", ".join(f"{sql} AS {name}" for name, sql in columns.items())
    return _with(
        views,
        f"SELECT source_dataset, {listed} FROM (SELECT s.source_dataset, count(*) AS n_total, "
        f"{_n(f'NOT {has}')} AS n_missing, {_n(has)} AS n_present, {_n(f'{has} AND t.fhir_id IS NOT NULL')} AS n_resolved "
        f"FROM {source} s LEFT JOIN {target} t ON t.source_dataset = s.source_dataset "
        f"AND t.fhir_id = split_part(s.{ref}, '/', {part}) GROUP BY s.source_dataset)",
    )


_RESOLVE_PCT = "round(100.0 * n_resolved / nullif(n_present, 0), 1)"


def _role_refs(ref: str, has: str, target: str, short: str) -> str:
    return _resolution(
        f"role {target}", "role", ref, has, target, -1,
        {
            "total_roles": "n_total",
            f"missing_{short}_ref": "n_missing",
            f"has_{short}_ref": "n_present",
            "resolved": "n_resolved",
            "pct_resolved": _RESOLVE_PCT,
        },
    )


def _managing(view: str) -> str:
    return _resolution(
        f"{view} org", view, "managing_ref", "has_managing", "org", 2,
        {"missing_managing_org": "n_missing", "unresolved_managing_org": "n_present - n_resolved"},
    )


_FRESH = {
    "organizations": ("org", "last_updated"),
    "practitioners": ("prac", "last_updated"),
    "practitioner_roles": ("role", "last_updated"),
    "locations": ("loc", "NULL::varchar"),
    "endpoints": ("ep", "last_updated"),
}


def _freshness(resources: list[str], typed: bool = False) -> str:
    def stamp(column: str) -> str:
        return f"strptime({column}, '%Y-%m-%dT%H:%M:%SZ')" if typed else column

    parts = [
        f"SELECT '{r}' AS resource_type, source_dataset, count({_FRESH[r][1]}) AS has_last_updated, "
        f"min({stamp(_FRESH[r][1])}) AS earliest, max({stamp(_FRESH[r][1])}) AS latest "
        f"FROM {_FRESH[r][0]} GROUP BY source_dataset"
        for r in resources
    ]
    return _with(" ".join(_FRESH[r][0] for r in resources), " UNION ALL ".join(parts))


_ALL = {
    "organizations": "org",
    "organization_affiliations": "aff",
    "practitioners": "prac",
    "practitioner_roles": "role",
    "locations": "loc",
    "endpoints": "ep",
}
_COUNTS = " UNION ALL ".join(
    f"SELECT '{r}' AS resource_type, source_dataset, count(*) AS record_count FROM {v} GROUP BY source_dataset"
    for r, v in _ALL.items()
)

_NPIS = (
    f"npis AS (SELECT source_dataset, e.value AS npi FROM "
    f"(SELECT source_dataset, unnest(identifiers) AS e FROM prac) WHERE e.system IN {NPI_ANY})"
)


def _npi_overlap(strict: bool) -> str:
    keep = "" if strict else " AND npi IS NOT NULL"

    def only(mine: str, other: str) -> str:
        return (
            f"(SELECT count(DISTINCT npi) FROM npis WHERE source_dataset = 'dataset-{mine}' "
            f"AND npi NOT IN (SELECT npi FROM npis WHERE source_dataset = 'dataset-{other}'{keep}))"
        )

    return _with(
        "prac",
        "SELECT (SELECT count(DISTINCT npi) FROM npis WHERE source_dataset = 'dataset-a') AS dataset_a_unique_npis, "
        "(SELECT count(DISTINCT npi) FROM npis WHERE source_dataset = 'dataset-b') AS dataset_b_unique_npis, "
        "(SELECT count(DISTINCT npi) FROM npis WHERE source_dataset = 'dataset-a' AND npi IN "
        "(SELECT npi FROM npis WHERE source_dataset = 'dataset-b')) AS npis_in_both, "
        f"{only('a', 'b')} AS only_in_a, {only('b', 'a')} AS only_in_b",
        _NPIS,
    )


def _ext(part: str) -> str:
    return f"len(list_filter(coalesce(ext, []), lambda u: contains(u, '{part}'))) > 0"


def _hierarchy(resolved: bool = False) -> str:
    """Chain lengths from the rule of the fixture: row k names row k div 3, rows with k % 17 = 0 name nobody.

    The ancestors of a row are known in advance, so its chain ends at the first one that is missing,
    has no parent or names nobody. Absolute references are read by their last segment only where resolved.
    """
    readable = "true" if resolved else "a"
    limit = ", count(*) FILTER (WHERE depth = 10) AS at_limit" if resolved else ""
    return _with(
        "org",
        f"SELECT source_dataset, max(depth)::bigint AS max_hierarchy_depth, avg(depth) AS avg_depth{limit} "
        "FROM reached GROUP BY source_dataset",
        f"""ranks AS (SELECT source_dataset, k, {readable} AS readable, unnest(range(10)) AS up FROM org WHERE k > 0),
ancestors AS (SELECT source_dataset, k, up, k // (3 ** up)::bigint AS at, readable FROM ranks),
steps AS (SELECT x.*, x.up = 0 OR (o.k IS NOT NULL AND x.readable AND (x.k // (3 ** greatest(x.up - 1, 0))::bigint) % 17 <> 0) AS ok
  FROM ancestors x LEFT JOIN org o ON o.source_dataset = x.source_dataset AND o.k = x.at AND o.k > 0),
reached AS (SELECT source_dataset, k, up + 1 AS depth FROM steps
  QUALIFY bool_and(ok) OVER (PARTITION BY source_dataset, k ORDER BY up))""",
    )


_SECONDS = "round({} / 1000.0, 1)"
_MB = "round({} / 1024.0 / 1024.0, 1)"


def _run_compare(runs: str) -> str:
    """The runs of a resource as one list per dataset; both lists are then unfolded."""
    lists = ", ".join(f"list(run) FILTER (source_dataset = 'dataset-{side}') AS {side}_runs" for side in "ab")
    columns = ", ".join(
        f"{side}_run.{field} AS dataset_{side}_{field}" for field in ("mb", "records", "process_sec") for side in "ab"
    )
    return f"""SELECT resource_type, {columns}, round(a_run.bytes::double / nullif(b_run.bytes, 0), 1) AS size_ratio_a_over_b
FROM (SELECT resource_type, a_run, unnest(b_runs) AS b_run FROM (
  SELECT resource_type, unnest(a_runs) AS a_run, b_runs FROM (
    SELECT resource_type, {lists} FROM (
      SELECT resource_type, source_dataset, struct_pack(bytes := compressed_size_bytes, records := record_count,
        mb := {_MB.format('compressed_size_bytes')}, process_sec := {_SECONDS.format('process_ms')}) AS run FROM {runs}
    ) GROUP BY resource_type)))"""


_ROLE_SAMPLE = """source_dataset, fhir_id, CASE WHEN a THEN 'true' END AS active, practitioner_ref, organization_ref,
  specialties[1].code AS primary_specialty_code, specialties[1].display AS primary_specialty_display,
  len(location_ids)::bigint AS location_count, has_available AS has_available_time, len(ext)::bigint AS ext_count"""

_TELECOM_JSON = """CASE WHEN has_telecom THEN '[{"system":"phone","value":"555-' || k || '"}]' END"""
_CITIES = """'[' || array_to_string(list_transform(range(1, n_address + 1), lambda i: '{"city":"City ' || i || '"}'), ',') || ']'"""
_ADDRESS_JSON = f"CASE WHEN n_address IS NOT NULL THEN {_CITIES} END"
_TYPE_JSON = (
    f"""CASE WHEN has_type THEN '[{{"coding":[{{"code":"N' || nk || '","display":"Nation ' || nk || '","system":"{EXAMPLE}/org-type"}}]}}]' END"""
)
_ENDPOINT_JSON = """CASE WHEN has_endpoint THEN '[{"reference":"Endpoint/ep-' || k || '"}]' END"""
_ORG_KEYED = (
    f"keyed AS (SELECT source_dataset, a, fhir_id, coalesce(last_updated, '') AS lu, name, {_TELECOM_JSON} AS telecom_json, "
    f"{_ADDRESS_JSON} AS address_json, {_TYPE_JSON} AS type_json, {_ENDPOINT_JSON} AS endpoint_json, "
    f"unnest(list_distinct([e.value FOR e IN identifiers IF e.system IN {NPI_ANY}])) AS npi FROM org)"
)
_ATTRIBUTES = ("telecom_json", "address_json", "type_json", "endpoint_json")


def _preferred(column: str, where: str = "true") -> str:
    return f"(array_agg({column} ORDER BY lu DESC, fhir_id DESC) FILTER (WHERE {column} IS NOT NULL AND {where}))[1]"


def _merged(column: str) -> str:
    return f"coalesce({_preferred(column, 'NOT a')}, {_preferred(column, 'a')}) AS {column}"


_IDENTIFIER_TEXT = """'[' || array_to_string(list_transform(identifiers, lambda e: CASE WHEN e.system IS NULL THEN '{"value":"' || e.value || '"}'
  ELSE '{"system":"' || e.system || '","value":"' || e.value || '"}' END), ',') || ']'"""

# The document as it is rendered, member by member, for its length in bytes.
_ORG_TEXT = f"""'{{"resourceType":"Organization","id":"' || fhir_id || '","meta":{{"profile":["' || profile || '"]'
  || coalesce(',"lastUpdated":"' || last_updated || '"', '') || '}}'
  || CASE WHEN a THEN ',"active":true' ELSE '' END || coalesce(',"name":"' || name || '"', '')
  || CASE WHEN has_alias THEN ',"alias":["Alias ' || k || '"]' ELSE '' END
  || coalesce(',"identifier":' || {_IDENTIFIER_TEXT}, '')
  || CASE WHEN has_type THEN ',"type":[{{"coding":[{{"system":"{EXAMPLE}/org-type","code":"N' || nk || '","display":"Nation ' || nk || '"}}]}}]' ELSE '' END
  || coalesce(',"telecom":' || {_TELECOM_JSON}, '') || coalesce(',"address":' || {_ADDRESS_JSON}, '')
  || CASE WHEN n_contact IS NOT NULL THEN ',"contact":[' || array_to_string(list_transform(range(1, n_contact + 1), lambda i: '{{"name":"Contact ' || i || '"}}'), ',') || ']' ELSE '' END
  || coalesce(',"endpoint":' || {_ENDPOINT_JSON}, '')
  || coalesce(',"partOf":{{"reference":"' || parent_ref || '"}}', '') || '}}'"""

_SHELL = "NOT (has_telecom OR n_address IS NOT NULL OR has_type OR has_endpoint)"

_ROLLUP = f"""rollup AS (SELECT source_dataset, split_part(practitioner_ref, '/', -1) AS pid, count(*) AS n, bool_or(has_specialty) AS specialty,
  bool_or(has_nucc) AS nucc, bool_or(has_location OR has_organization) AS place, bool_or(has_telecom OR has_endpoint) AS contact,
  bool_or(has_available) AS available, bool_or({_ext('newpatients')}) AS new_patients, bool_or({_ext('network')}) AS network
  FROM role WHERE has_practitioner GROUP BY ALL)"""


def _edges() -> str:
    fields = [
        ("organizations", "org", "partOf", "parent_ref"),
        ("practitioner_roles", "role", "practitioner", "practitioner_ref"),
        ("practitioner_roles", "role", "organization", "organization_ref"),
        ("organization_affiliations", "aff", "organization", "organization_ref"),
        ("organization_affiliations", "aff", "participatingOrganization", "participating_ref"),
        ("locations", "loc", "managingOrganization", "managing_ref"),
        ("endpoints", "ep", "managingOrganization", "managing_ref"),
    ]
    parts = [
        f"SELECT '{r}' AS resource_type, source_dataset, '{f}' AS field, a FROM {v} WHERE {c} IS NOT NULL"
        for r, v, f, c in fields
    ]
    return _with(
        "org role aff loc ep",
        "SELECT resource_type, source_dataset, field, CASE WHEN a THEN 'relative' ELSE 'absolute' END AS format, "
        "CASE WHEN NOT a THEN 'dir.example.org' END AS host, count(*) AS occurrences FROM edges GROUP BY ALL",
        f"edges AS ({' UNION ALL '.join(parts)})",
    )


_LOCATION_LINKS = """links AS (SELECT r.source_dataset, r.k, r.loc, l.fhir_id IS NOT NULL AS found
  FROM (SELECT source_dataset, k, unnest(location_ids) AS loc FROM role) r
  LEFT JOIN loc l ON l.source_dataset = r.source_dataset AND l.fhir_id = r.loc)"""

_SENT = """WITH all_lines AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'first' ELSE 'second' END AS part
  FROM (SELECT 'dataset-a' AS source_dataset, * FROM events UNION ALL SELECT 'dataset-b', * FROM events WHERE value >= 50))"""
_LAST_WRITES = f"""{_SENT}, sent AS (SELECT * FROM all_lines WHERE event_type <> 'error')
SELECT source_dataset, 'ep-' || user_id AS fhir_id, strftime(arg_max(ts, event_id), '%Y-%m-%dT%H:%M:%SZ') AS last_updated,
  arg_max(event_type, event_id) AS status, 'https://ep.example.org/' || max(event_id) AS address"""

EXPECTED: dict[str, str] = {
    "run_report": _with(
        "runs",
        f"SELECT source_dataset, resource_type, compression, record_count, error_count, {_MB.format('compressed_size_bytes')} AS compressed_size_mb, "
        f"{_SECONDS.format('download_ms')} AS download_sec, {_SECONDS.format('process_ms')} AS process_sec, "
        f"{_SECONDS.format('(download_ms + process_ms)')} AS total_sec, "
        "round(record_count / (nullif(process_ms, 0) / 1000.0), 0) AS records_per_sec FROM runs",
    ),
    "run_compare": _with("runs", _run_compare("runs")),
    "run_compare_latest": _with(
        "runs",
        _run_compare("latest"),
        "latest AS (SELECT * FROM runs QUALIFY row_number() OVER "
        "(PARTITION BY resource_type, source_dataset ORDER BY run_at DESC, source_file DESC) = 1)",
    ),
    "run_totals": _with(
        "runs",
        "SELECT source_dataset, sum(record_count)::bigint AS records, sum(error_count)::bigint AS errors, "
        "sum(download_ms + process_ms)::bigint AS total_ms FROM runs GROUP BY source_dataset",
    ),
    "record_counts": _with("org aff prac role loc ep", _COUNTS),
    "dataset_comparison": _with(
        "org aff prac role loc ep",
        "SELECT coalesce(resource_type, 'TOTAL') AS resource_type, "
        "(sum(record_count) FILTER (WHERE source_dataset = 'dataset-a'))::bigint AS dataset_a, "
        "(sum(record_count) FILTER (WHERE source_dataset = 'dataset-b'))::bigint AS dataset_b, "
        "round(sum(record_count) FILTER (WHERE source_dataset = 'dataset-a')::double / "
        "nullif(sum(record_count) FILTER (WHERE source_dataset = 'dataset-b'), 0), 1) AS ratio "
        "FROM counts GROUP BY ROLLUP (resource_type)",
        f"counts AS ({_COUNTS})",
    ),
    "organization_id_overlap": _with(
        "org",
        "SELECT 'organizations' AS resource_type, (SELECT count(*) FROM org WHERE a) AS dataset_a_total, "
        "(SELECT count(*) FROM org WHERE NOT a) AS dataset_b_total, "
        "(SELECT count(DISTINCT fhir_id) FROM org WHERE NOT a AND fhir_id IN (SELECT fhir_id FROM org WHERE a)) AS in_both, "
        "(SELECT count(*) FROM org WHERE a AND fhir_id NOT IN (SELECT fhir_id FROM org WHERE NOT a)) AS only_in_a, "
        "(SELECT count(*) FROM org WHERE NOT a AND fhir_id NOT IN (SELECT fhir_id FROM org WHERE a)) AS only_in_b",
    ),
    "freshness": _freshness(list(_FRESH)),
    "freshness_core": _freshness(["organizations", "practitioners", "practitioner_roles"]),
    "freshness_typed": _freshness(["organizations", "practitioners", "practitioner_roles"], typed=True),
    "practitioner_npi_overlap": _npi_overlap(False),
    "practitioner_npi_overlap_strict": _npi_overlap(True),
    "role_practitioner_refs_relative": _resolution(
        "role prac", "role", "practitioner_ref", "has_practitioner", "prac", 2,
        {
            "total_roles": "n_total",
            "missing_practitioner_ref": "n_missing",
            "unresolved_practitioner_refs": "n_present - n_resolved",
            "pct_resolve": _RESOLVE_PCT,
        },
    ),
    "role_organization_refs_relative": _resolution(
        "role org", "role", "organization_ref", "has_organization", "org", 2,
        {
            "missing_org_ref": "n_missing",
            "unresolved_org_refs": "n_present - n_resolved",
            "pct_resolve": _RESOLVE_PCT,
        },
    ),
    "affiliation_organization_refs": _with(
        "aff org",
        f"SELECT x.source_dataset, {_n('has_participating AND p.fhir_id IS NULL')} AS unresolved_participating_org, "
        f"{_n('o.fhir_id IS NULL')} AS unresolved_parent_org FROM aff x "
        "LEFT JOIN org p ON p.source_dataset = x.source_dataset AND p.fhir_id = split_part(participating_ref, '/', 2) "
        "LEFT JOIN org o ON o.source_dataset = x.source_dataset AND o.fhir_id = split_part(organization_ref, '/', 2) "
        "GROUP BY x.source_dataset",
    ),
    "location_organization_refs": _managing("loc"),
    "endpoint_organization_refs": _managing("ep"),
    "role_practitioner_refs": _role_refs("practitioner_ref", "has_practitioner", "prac", "practitioner"),
    "role_organization_refs": _role_refs("organization_ref", "has_organization", "org", "org"),
    "role_location_refs": _with(
        "role loc",
        f"SELECT r.source_dataset, count(*) AS total_roles, {_n('NOT has_location')} AS missing_location_ref, "
        f"{_n('has_location')} AS has_location_ref, {_n('f.found')} AS resolved_count FROM role r LEFT JOIN "
        "(SELECT source_dataset, k, bool_or(found) AS found FROM links GROUP BY ALL) f "
        "ON f.source_dataset = r.source_dataset AND f.k = r.k GROUP BY r.source_dataset",
        _LOCATION_LINKS,
    ),
    "role_location_single_refs": _with(
        "role loc",
        f"SELECT source_dataset, count(*) AS n_references, {_n('found')} AS resolved_references FROM links GROUP BY source_dataset",
        _LOCATION_LINKS,
    ),
    "organization_parent_refs": _with(
        "org",
        f"SELECT o.source_dataset, {_n('o.has_parent')} AS total_with_parent, {_n('p.fhir_id IS NOT NULL')} AS resolved, "
        f"{_pct(_n('p.fhir_id IS NOT NULL'), _n('o.has_parent'))} AS pct_resolved FROM org o LEFT JOIN org p "
        "ON p.source_dataset = o.source_dataset AND p.fhir_id = split_part(o.parent_ref, '/', 2) GROUP BY o.source_dataset",
    ),
    "reference_formats": _edges(),
    "practitioner_npi_single_system": _npi("prac", f"('{NPI_SYSTEM_A}')"),
    "organization_npi_single_system": _npi("org", f"('{NPI_SYSTEM_A}')"),
    "practitioner_npi": _npi("prac", NPI_ANY),
    "organization_npi": _npi("org", NPI_ANY),
    "practitioner_identifier_systems": _elements("prac", "identifiers", {"identifier_system": "e.system"}),
    "organization_identifier_systems": _elements("org", "identifiers", {"identifier_system": "e.system"}),
    "role_identifier_systems": _with(
        "role",
        f"SELECT source_dataset, '{EXAMPLE}/role-id' AS identifier_system, count(*) AS occurrences FROM role WHERE has_identifier GROUP BY source_dataset",
    ),
    "role_identifier_coverage": _by_dataset(
        "role",
        {"total": "count(*)", "has_identifier": _n("has_identifier"), "pct_has_identifier": _pct(_n("has_identifier"))},
    ),
    "organization_identifier_sample": _with(
        "org",
        f"SELECT {_IDENTIFIER_TEXT} AS identifier FROM org WHERE a AND identifiers IS NOT NULL "
        f"AND NOT {_with_system(f"('{NPI_SYSTEM_A}')")} ORDER BY fhir_id LIMIT 3",
    ),
    "identifier_fragmentation": _with(
        "org",
        f"SELECT source_dataset, count(*) AS distinct_values, sum(owners)::bigint AS value_owner_pairs, "
        f"{_n('owners > 1')} AS values_with_many_owners, max(owners) AS max_owners, round(avg(owners), 2) AS avg_owners "
        "FROM (SELECT source_dataset, npi, count(DISTINCT fhir_id) AS owners FROM keyed WHERE npi IS NOT NULL GROUP BY ALL) GROUP BY source_dataset",
        _ORG_KEYED,
    ),
    "identifier_quality": _by_dataset(
        "org",
        {
            "total": "count(*)",
            "has_uuid_value": _n("a AND k % 6 = 1"),
            "has_wrong_system": _n("a AND k % 6 = 1"),
            "has_duplicate_identifier": _n("a AND k % 6 = 3"),
            "pct_duplicate_identifier": _pct(_n("a AND k % 6 = 3")),
        },
    ),
    "practitioner_completeness": _complete(
        "prac", identifier="identifiers IS NOT NULL", name="true", gender="gender IS NOT NULL",
        qualification="has_qualification", communication="has_communication", active="a", photo="has_photo",
    ),
    "practitioner_core_completeness": _complete(
        "prac", active="a", name="true", gender="gender IS NOT NULL", any_identifier="identifiers IS NOT NULL",
        telecom="has_telecom", address="has_address", qualification="has_qualification",
        communication="has_communication",
    ),
    "practitioner_completeness_brief": _complete(
        "prac", name="true", gender="gender IS NOT NULL", qualification="has_qualification",
        communication="has_communication", active="a",
    ),
    "organization_completeness": _complete(
        "org", identifier="identifiers IS NOT NULL", active="a", type="has_type", name="name IS NOT NULL",
        alias="has_alias", telecom="has_telecom", address="n_address IS NOT NULL", contact="has_contact",
        endpoint_ref="has_endpoint",
    ),
    "organization_completeness_brief": _complete(
        "org", active="a", type="has_type", name="name IS NOT NULL", telecom="has_telecom",
        address="n_address IS NOT NULL", endpoint_ref="has_endpoint",
    ),
    "organization_parent_presence": _by_dataset(
        "org", {"total": "count(*)", "has_part_of": _n("has_parent"), "pct_has_part_of": _pct(_n("has_parent"))}
    ),
    "role_completeness": _complete(
        "role", active="a", practitioner="has_practitioner", organization="has_organization", code="true",
        specialty="has_specialty", location="has_location", endpoint="has_endpoint", available_time="has_available",
        not_available="has_not_available",
    ),
    "role_core_completeness": _complete(
        "role", active="a", practitioner="has_practitioner", organization="has_organization", role_code="true",
        specialty="has_specialty", location="has_location", telecom="has_telecom", endpoint="has_endpoint",
        available_time="has_available", not_available="has_not_available",
    ),
    "role_completeness_brief": _complete(
        "role", active="a", practitioner="has_practitioner", organization="has_organization",
        specialty="has_specialty", location="has_location", endpoint="has_endpoint", available_time="has_available",
    ),
    "affiliation_completeness": _complete(
        "aff", active="a", organization="true", participating_org="has_participating", code="true",
        specialty="has_specialty", location="has_location", endpoint="has_endpoint",
    ),
    "location_completeness": _complete(
        "loc", status="true", name="has_name", type="true", telecom="has_telecom", address="has_address",
        position="has_position", managing_org="has_managing", hours_of_operation="has_hours",
    ),
    "endpoint_completeness": _complete(
        "ep", status="status IS NOT NULL", connection_type="has_connection", name="has_name",
        managing_org="has_managing", payload_type="has_payload", address="has_address",
    ),
    "endpoint_payload_coverage": _by_dataset(
        "ep",
        {
            "total": "count(*)",
            "has_payload_type": _n("has_payload"),
            "pct_payload_type": _pct(_n("has_payload")),
            "has_address": _n("has_address"),
            "pct_address": _pct(_n("has_address")),
        },
    ),
    "role_availability": _by_dataset(
        "role",
        {
            "total": "count(*)",
            "has_available_time": _n("has_available"),
            "has_not_available": _n("has_not_available"),
            "pct_available_time": _pct(_n("has_available")),
            "pct_not_available": _pct(_n("has_not_available")),
        },
    ),
    "role_contact_invariant": _by_dataset(
        "role",
        {
            "total": "count(*)",
            "has_telecom": _n("has_telecom"),
            "has_endpoint": _n("has_endpoint"),
            "has_telecom_or_endpoint": _n("has_telecom OR has_endpoint"),
            "missing_both": _n("NOT has_telecom AND NOT has_endpoint"),
            "pct_missing_both": _pct(_n("NOT has_telecom AND NOT has_endpoint")),
        },
    ),
    "role_new_patients_extension": _by_dataset(
        "role",
        {
            "total": "count(*)",
            "has_new_patients_ext": _n(_ext("newpatients")),
            "pct_has_new_patients": _pct(_n(_ext("newpatients"))),
        },
        "ext IS NOT NULL",
    ),
    "role_network_extension": _by_dataset(
        "role",
        {"has_network_ext": _n(_ext("network")), "pct_has_network": _pct(_n(_ext("network")), _n("ext IS NOT NULL"))},
    ),
    "practitioner_qualification_extension": _by_dataset(
        "prac",
        {
            "has_qualification_ext": _n(_ext("qualification")),
            "pct_has_qualification_ext": _pct(_n(_ext("qualification")), _n("ext IS NOT NULL")),
        },
    ),
    "location_accessibility_extension": _by_dataset(
        "loc",
        {
            "has_accessibility_ext": _n("has_accessibility"),
            "pct_has_accessibility": _pct(_n("has_accessibility"), _n("has_extension")),
        },
    ),
    "practitioner_extension_census": _by_dataset(
        "prac",
        {
            "total": "count(*)",
            "has_any_extension": _n("ext IS NOT NULL"),
            "has_endpoint_ref_ext": _n(_ext("endpoint")),
            "has_verification_status": _n(_ext("verification-status")),
            "has_comm_proficiency": _n(_ext("communication-proficiency")),
            "has_rating": _n(_ext("rating")),
            "has_accessibility": _n(_ext("accessibility")),
        },
    ),
    "role_extension_census": _by_dataset(
        "role",
        {
            "total": "count(*)",
            "has_any_extension": _n("ext IS NOT NULL"),
            "has_new_patients": _n(_ext("newpatients")),
            "has_network": _n(_ext("network")),
            "has_verification_status": _n(_ext("verification-status")),
            "has_qualification_ext": _n(_ext("qualification")),
            "has_rating": _n(_ext("rating")),
        },
    ),
    "practitioner_extension_urls_top": _elements("prac", "ext", {"extension_url": f"'{EXAMPLE}/ext/' || e"}, 50),
    "practitioner_extension_urls": _elements("prac", "ext", {"extension_url": f"'{EXAMPLE}/ext/' || e"}),
    "role_extension_urls": _elements("role", "ext", {"extension_url": f"'{EXAMPLE}/ext/' || e"}),
    "profile_census": _with("org", "SELECT source_dataset, profile, count(*) AS occurrences FROM org GROUP BY ALL"),
    "role_specialty_coding": _by_dataset(
        "role",
        {
            "total_with_specialty": "count(*)",
            "has_nucc_specialty": _n("has_nucc"),
            "pct_nucc_coded": _pct(_n("has_nucc")),
        },
        "has_specialty",
    ),
    "role_specialty_coverage": _by_dataset(
        "role",
        {
            "total": "count(*)",
            "has_specialty": _n("has_specialty"),
            "pct_has_specialty": _pct(_n("has_specialty")),
            "has_nucc_specialty": _n("has_nucc"),
            "pct_nucc_specialty": _pct(_n("has_nucc")),
        },
    ),
    "role_specialty_codes_top30": _elements("role", "specialties", _CODING, 30),
    "role_specialty_codes": _elements("role", "specialties", _CODING, 40),
    "role_specialty_codes_per_dataset": _with(
        "role",
        "SELECT source_dataset, e.system AS system, e.code AS code, e.display AS display, count(*) AS occurrences "
        "FROM (SELECT source_dataset, unnest(specialties) AS e FROM role) GROUP BY source_dataset, e.system, e.code, e.display "
        "QUALIFY row_number() OVER (PARTITION BY source_dataset ORDER BY count(*) DESC, e.system, e.code, e.display) <= 20",
    ),
    "role_codes": _single_coding("role", f"'{EXAMPLE}/role-code'", "status", "'Status ' || status"),
    "organization_type_codes": _single_coding("org", f"'{EXAMPLE}/org-type'", "'N' || nk", "'Nation ' || nk", "has_type"),
    "affiliation_codes": _single_coding("aff", f"'{EXAMPLE}/affiliation-role'", "flag", "'Flag ' || flag"),
    "qualification_codes": _with(
        "prac",
        f"SELECT source_dataset, '{SPECIALTY_SYSTEM}' AS system, 'Q' || i AS code, 'Qualification ' || i AS display, count(*) AS occurrences "
        "FROM (SELECT source_dataset, unnest(range(1, n_qual + 1)) AS i FROM prac) GROUP BY ALL "
        "ORDER BY source_dataset, occurrences DESC, system, code, display LIMIT 40",
    ),
    "qualification_code_systems": _with(
        "prac",
        f"SELECT source_dataset, '{SPECIALTY_SYSTEM}' AS code_system, sum(n_qual)::bigint AS occurrences FROM prac GROUP BY ALL",
    ),
    "qualification_depth": _by_dataset(
        "prac",
        {
            "total": "count(*)",
            "has_qualification": _n("n_qual > 0"),
            "has_qual_code": _n("n_qual > 0"),
            "has_qual_issuer": _n("n_qual > 0"),
            "has_qual_period": _n("n_qual > 1"),
            "has_qual_extension": _n("n_qual > 2 AND a"),
        },
    ),
    "qualification_counts": _by_dataset(
        "prac",
        {
            "avg_qualifications_per_practitioner": "round(avg(n_qual), 2)",
            "max_qualifications": "max(n_qual)::bigint",
            "min_qualifications": "min(n_qual)::bigint",
        },
        "has_qualification",
    ),
    "specialty_counts": _by_dataset(
        "role",
        {
            "avg_specialties_per_role": "round(avg(n_specialty), 2)",
            "max_specialties": "max(n_specialty)::bigint",
            "min_specialties": "min(n_specialty)::bigint",
        },
        "has_specialty",
    ),
    "availability_weekdays": _elements("role", "days", {"day_of_week": "e"}),
    "availability_weekdays_plain": _elements("role", "days", {"day_of_week": "trim(e, '\"')"}),
    "endpoint_connection_types": _with(
        "ep",
        f"SELECT source_dataset, '{EXAMPLE}/connection' AS connection_type_system, event_type AS connection_type_code, "
        "count(*) AS occurrences FROM ep WHERE has_connection GROUP BY ALL",
    ),
    "endpoint_status": _with("ep", "SELECT source_dataset, status, count(*) AS occurrences FROM ep GROUP BY ALL"),
    "practitioner_role_coverage": _with(
        "prac role",
        "SELECT p.source_dataset, count(*) AS total_practitioners, "
        f"{_n('r.pid IS NOT NULL')} AS practitioners_with_role, {_pct(_n('r.pid IS NOT NULL'))} AS pct_with_role, "
        f"count(*) - {_n('r.pid IS NOT NULL')} AS practitioners_without_role "
        f"FROM (SELECT * FROM prac WHERE {_with_system(NPI_ANY)}) p LEFT JOIN rollup r "
        "ON r.source_dataset = p.source_dataset AND r.pid = p.fhir_id GROUP BY p.source_dataset",
        _ROLLUP,
    ),
    "directory_completeness": _with(
        "prac role",
        "SELECT p.source_dataset, count(*) AS total_practitioners, "
        + ", ".join(
            f"{_pct(_n(condition))} AS {name}"
            for name, condition in {
                "pct_npi": _with_system(NPI_ANY),
                "pct_active": "a",
                "pct_name": "true",
                "pct_gender": "gender IS NOT NULL",
                "pct_qualification": "has_qualification",
                "pct_with_any_role": "r.pid IS NOT NULL",
                "pct_with_specialty_via_role": "r.specialty",
                "pct_with_nucc_specialty": "r.nucc",
                "pct_with_location_or_org": "r.place",
                "pct_with_contact": "r.contact",
                "pct_with_availability": "r.available",
                "pct_with_new_patients": "r.new_patients",
                "pct_with_network": "r.network",
                "pct_directory_complete": f"{_with_system(NPI_ANY)} AND a AND r.nucc AND r.place AND r.contact",
            }.items()
        )
        + " FROM prac p LEFT JOIN rollup r ON r.source_dataset = p.source_dataset AND r.pid = p.fhir_id GROUP BY p.source_dataset",
        _ROLLUP,
    ),
    "roles_per_practitioner": _with(
        "role",
        "SELECT source_dataset, min(n) AS min_roles, max(n) AS max_roles, round(avg(n), 2) AS avg_roles, quantile_cont(n, 0.5)::double AS median_roles, "
        f"{_n('n = 1')} AS practitioners_with_1_role, {_n('n = 2')} AS practitioners_with_2_roles, {_n('n >= 3')} AS practitioners_with_3plus_roles "
        "FROM rollup GROUP BY source_dataset",
        _ROLLUP,
    ),
    "organization_hierarchy_depth": _hierarchy(),
    "organization_hierarchy_depth_resolved": _hierarchy(resolved=True),
    "organization_oversized_arrays": _with(
        "org",
        "SELECT source_dataset, fhir_id, name, n_address::bigint AS address_count, CASE WHEN has_telecom THEN 1::bigint END AS telecom_count, "
        f"len(identifiers)::bigint AS identifier_count, n_contact::bigint AS contact_count, strlen({_ORG_TEXT})::bigint AS json_size_bytes "
        "FROM org WHERE n_address > 100 OR n_contact > 100",
    ),
    "shell_records": _by_dataset(
        "org",
        {
            "total": "count(*)",
            "shell": _n(_SHELL),
            "shell_with_name": _n(f"{_SHELL} AND name IS NOT NULL"),
            "pct_shell": _pct(_n(_SHELL)),
        },
    ),
    "malformed_arrays": _by_dataset(
        "loc", {"total": "count(*)", "address_not_array": _n("has_address"), "telecom_not_array": "0::bigint"}
    ),
    "practitioner_sample": _with(
        "prac role",
        "SELECT p.source_dataset, p.fhir_id, CASE WHEN a THEN 'true' END AS active, c_name AS name, gender, "
        f"[e.value FOR e IN identifiers IF e.system IN {NPI_ANY}][1] AS npi, n_qual::bigint AS qual_count, len(ext)::bigint AS ext_count, "
        "coalesce(r.n, 0) AS role_count FROM (SELECT * FROM prac WHERE has_qualification ORDER BY source_dataset, fhir_id LIMIT 10) p "
        "LEFT JOIN rollup r ON r.source_dataset = p.source_dataset AND r.pid = p.fhir_id",
        _ROLLUP,
    ),
    "role_sample": _with("role", f"SELECT {_ROLE_SAMPLE} FROM role ORDER BY source_dataset, fhir_id LIMIT 10"),
    "role_sample_per_dataset": _with(
        "role",
        f"SELECT {_ROLE_SAMPLE} FROM role QUALIFY row_number() OVER (PARTITION BY source_dataset ORDER BY fhir_id) <= 10",
    ),
    "organization_consolidation": _with(
        "org",
        "SELECT source_dataset, npi, count(*) AS owners, min(fhir_id) AS fhir_id, "
        + ", ".join(f"{_preferred(c)} AS {c}" for c in ("name", *_ATTRIBUTES))
        + " FROM keyed GROUP BY source_dataset, npi",
        _ORG_KEYED,
    ),
    "organization_reconciliation": _with(
        "org",
        f"SELECT npi, min(fhir_id) FILTER (WHERE NOT a) AS fhir_id, {_merged('name')}, {_n('a')} AS enriching_records, "
        + ", ".join(_merged(c) for c in _ATTRIBUTES)
        + " FROM keyed GROUP BY npi HAVING count(*) FILTER (WHERE NOT a) > 0",
        _ORG_KEYED,
    ),
    "ingest_upsert": f"{_LAST_WRITES} FROM sent GROUP BY source_dataset, user_id",
    "incremental_ingest": f"{_LAST_WRITES} FROM sent WHERE source_dataset = 'dataset-a' GROUP BY source_dataset, user_id",
    "ingest_run_log": f"{_SENT} SELECT part || '.ndjson' AS source_file, source_dataset, 'endpoints' AS resource_type, "
    "count(*) FILTER (WHERE event_type <> 'error') AS record_count, count(*) FILTER (WHERE event_type = 'error') AS error_count, "
    "0::bigint AS blank_count, count(*) FILTER (WHERE event_type <> 'error') - count(DISTINCT user_id) FILTER (WHERE event_type <> 'error') "
    "AS duplicate_count FROM all_lines GROUP BY source_dataset, part",
    "ingest_totals": f"{_SENT} SELECT source_dataset, count(*) FILTER (WHERE event_type <> 'error') AS records, "
    "count(*) FILTER (WHERE event_type = 'error') AS errors FROM all_lines GROUP BY source_dataset",
    "ingest_rejected": f"{_SENT} SELECT source_dataset, 'not a document' AS problem, count(*) AS lines FROM all_lines "
    "WHERE event_type = 'error' GROUP BY source_dataset",
    "incremental_rejected": "SELECT 'dataset-a' AS source_dataset, 'not a document' AS problem, count(*) AS lines FROM events WHERE event_type = 'error'",
    "incremental_run_log": "SELECT 'dataset-a' AS source_dataset, 'endpoints' AS resource_type, 'gz' AS compression, "
    "count_if(event_type <> 'error')::bigint AS records, count_if(event_type = 'error')::bigint AS errors, 0::bigint AS blanks FROM events",
    "stored_reload_report": "SELECT source_dataset, status, count(*) AS occurrences "
    f"FROM ({_LAST_WRITES} FROM sent GROUP BY source_dataset, user_id) GROUP BY ALL",
}
