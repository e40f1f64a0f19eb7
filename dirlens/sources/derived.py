"""Directory documents derived from the star-schema test tables.

Every resource is a pure function of one table's rows, rendered to JSON text and parsed like a
delivered document. ``dataset-a`` delivers every row; ``dataset-b`` delivers the rows its own
attribute rule selects. The two deliveries differ the way real ones do: absolute or relative
references, other identifier systems, members only one side fills in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dirlens.schema import DATASET_A, DATASET_B, NPI_SYSTEM_A, NPI_SYSTEM_B, SPECIALTY_SYSTEM, SSN_SYSTEM
from dirlens.sources.partitions import bounded, tasks

#: Rows of ``lineitem`` that one task folds to orders, several of them to one document.
LINES = 200_000

BASE = "http://dir.example.org/fhir/"
EXAMPLE = "http://directory.example.org"

# Rows of dataset-b, by a property of the source row.
IN_DATASET_B = {
    "organizations": "s_acctbal >= 0",
    "practitioners": "c_mktsegment <> 'HOUSEHOLD'",
    "practitioner_roles": "o_totalprice >= 250000",
    "locations": "p_size <= 17",
    "endpoints": "event_type IN ('click', 'error')",
    "organization_affiliations": "flag <> 'A'",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows become one document each."""
    return bounded(_table(spark, sf_dir, name))


def _ref(kind: str, name: str) -> str:
    """A reference object, relative in dataset-a and absolute in dataset-b."""
    return f"named_struct('reference', concat(if(a, '', '{BASE}'), '{kind}/', {name}))"


def _concept(system: str, code: str, display: str = "cast(null as string)") -> str:
    return (
        f"named_struct('coding', array(named_struct('system', {system}, 'code', {code}, 'display', {display})))"
    )


def _extension(name: str) -> str:
    return f"named_struct('url', '{EXAMPLE}/ext/{name}')"


def _render(df: DataFrame, resource: str, kind: str, fhir_id: str, members: dict[str, str]) -> DataFrame:
    """One JSON document per row and dataset; NULL members are left out."""
    datasets = F.when(F.expr(IN_DATASET_B[resource]), F.array(F.lit(DATASET_A), F.lit(DATASET_B))).otherwise(
        F.array(F.lit(DATASET_A))
    )
    rows = (
        df.withColumn("source_dataset", F.explode(datasets))
        .withColumn("a", F.col("source_dataset") == DATASET_A)
        .withColumn("fhir_id", F.expr(fhir_id))
    )
    fields = ", ".join(f"'{name}', {rule}" for name, rule in members.items())
    whole = f"to_json(named_struct('resourceType', '{kind}', 'id', fhir_id, {fields}))"
    return rows.select(
        "source_dataset",
        "fhir_id",
        F.expr(whole).alias("raw_json"),
    )


def _organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    npi_a = f"named_struct('system', '{NPI_SYSTEM_A}', 'value', cast(1000000000 + k div 2 as string))"
    npi_b = f"named_struct('system', '{NPI_SYSTEM_B}', 'value', cast(1000000000 + k as string))"
    uuid = f"named_struct('system', '{SSN_SYSTEM}', 'value', concat('00000000-0000-4000-8000-', lpad(k, 12, '0')))"
    legacy = "named_struct('system', cast(null as string), 'value', concat('legacy-', k))"
    return _render(
        _rows(spark, sf_dir, "supplier").withColumnsRenamed({"s_suppkey": "k", "s_nationkey": "nk"}),
        "organizations",
        "Organization",
        "concat('org-', k)",
        {
            "meta": "named_struct('profile', array(concat("
            f"'{EXAMPLE}/profile/', if(a, 'directory-organization', 'core-organization'))), "
            "'lastUpdated', if(a, concat('2024-', lpad(1 + nk % 12, 2, '0'), '-15T08:00:00Z'), null))",
            "active": "if(a, true, null)",
            "name": "if(not a or s_acctbal >= 0, s_name, null)",
            "alias": "if(a and k % 9 = 0, array(concat('Alias ', k)), null)",
            "identifier": f"case when not a then array({npi_b}) when k % 6 = 1 then array({uuid}) "
            f"when k % 6 = 3 then array({npi_a}, {npi_a}) when k % 6 = 4 then array({npi_a}, {legacy}) "
            f"when k % 6 in (2, 5) then array({npi_a}) end",
            "type": f"if(a and k % 4 = 1, array({_concept(repr(EXAMPLE + '/org-type'), 'concat(\'N\', nk)', 'concat(\'Nation \', nk)')}), null)",
            "telecom": "if(a and k % 5 < 2, array(named_struct('system', 'phone', 'value', concat('555-', k))), null)",
            "address": "if(a, transform(sequence(1, if(k % 50 = 7, 150, 1 + k % 3)), "
            "i -> named_struct('city', concat('City ', i))), null)",
            "contact": "if(a and k % 7 = 0, transform(sequence(1, if(k % 50 = 21, 101, 1)), "
            "i -> named_struct('name', concat('Contact ', i))), null)",
            "endpoint": "if(a and k % 8 = 0, array(named_struct('reference', concat('Endpoint/ep-', k))), null)",
            "partOf": f"if(k > 0, {_ref('Organization', 'if(k % 17 = 0, \'org-x\', \'org-\'), k div 3')}, null)",
        },
    )


def _practitioners(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = "cast(2000000000 + k as string)"
    npi_a = f"named_struct('system', '{NPI_SYSTEM_A}', 'value', {value})"
    npi_b = f"named_struct('system', '{NPI_SYSTEM_B}', 'value', {value})"
    npi_void = f"named_struct('system', '{NPI_SYSTEM_B}', 'value', cast(null as string))"
    license_id = f"named_struct('system', '{EXAMPLE}/license', 'value', concat('L', k))"
    endpoint, verified = _extension("endpoint-reference"), _extension("verification-status")
    qualified = _extension("base-ext-qualification")
    code = _concept(f"'{SPECIALTY_SYSTEM}'", "concat('Q', i)", "concat('Qualification ', i)")
    return _render(
        _rows(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "k"),
        "practitioners",
        "Practitioner",
        "concat('prac-', if(a, 'a-', 'b-'), k)",
        {
            "meta": "if(a, named_struct('lastUpdated', concat('2023-', lpad(1 + k % 12, 2, '0'), '-', "
            "lpad(1 + k % 28, 2, '0'), 'T00:00:00Z')), null)",
            "active": "if(a, true, null)",
            "name": "array(named_struct('text', c_name))",
            "gender": "if(a and k % 10 <> 0, if(k % 2 = 0, 'female', 'male'), null)",
            "identifier": f"case when not a and k % 13 = 0 then array({npi_void}) when not a then array({npi_b}) "
            f"when c_nationkey = 0 then array({license_id}) when k % 7 = 0 then array({npi_a}, {npi_b}) "
            f"else array({npi_a}) end",
            "qualification": "if(k % 4 = 0, null, transform(sequence(1, k % 4), i -> named_struct("
            f"'code', {code}, "
            "'issuer', if(i = 1, named_struct('reference', 'Organization/org-1'), null), "
            "'period', if(i = 2, named_struct('start', '2020-01-01'), null), "
            f"'extension', if(i = 3 and a, array({qualified}), null))))",
            "extension": f"case when a and k % 15 = 0 then array({endpoint}, {verified}) "
            f"when a and k % 3 = 0 then array({endpoint}) when a and k % 5 = 0 then array({qualified}) end",
            "communication": "if(c_mktsegment = 'MACHINERY', array(named_struct('text', 'en')), null)",
            "telecom": "if(a or k % 3 <> 0, array(named_struct('value', concat('555-', k))), null)",
            "address": "if(a or c_mktsegment IN ('AUTOMOBILE', 'FURNITURE'), array(named_struct('city', 'X')), null)",
            "photo": "if(a and k % 20 = 0, array(named_struct('title', 'portrait')), null)",
        },
    )


def _practitioner_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    person = f"concat(if(a, '', '{BASE}'), 'Practitioner/prac-', if(a, 'a-', 'b-'), o_custkey)"
    label = "substring(o_orderpriority, 3)"
    nucc = f"named_struct('system', '{SPECIALTY_SYSTEM}', 'code', o_orderpriority, 'display', {label})"
    other = f"named_struct('system', '{EXAMPLE}/specialty', 'code', o_orderpriority, 'display', {label})"
    concept = "named_struct('coding', array({}), 'text', cast(null as string))"
    bare = f"named_struct('coding', if(false, array({other}), null), 'text', 'free text')"
    new_patients, network, rating = _extension("newpatients"), _extension("network"), _extension("rating")
    places = f"concat(if(a, '', '{BASE}'), 'Location/loc-', o_custkey + i)"
    return _render(
        _rows(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "k"),
        "practitioner_roles",
        "PractitionerRole",
        "concat('role-', if(a, 'a-', 'b-'), k)",
        {
            "meta": "named_struct('lastUpdated', date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\"))",
            "active": "if(a, true, null)",
            "identifier": f"if(k % 4 = 1, array(named_struct('system', '{EXAMPLE}/role-id', 'value', k)), null)",
            "practitioner": "case when k % 50 = 0 then null "
            "when k % 50 = 1 then named_struct('reference', cast(null as string), 'display', 'unlinked') "
            f"else named_struct('reference', {person}, 'display', cast(null as string)) end",
            # A third of all roles refers to one organization.
            "organization": "if(k % 40 = 7, null, "
            + _ref("Organization", "'org-', if(k % 3 = 0, 1, o_custkey % 130)")
            + ")",
            "location": f"case when k % 25 = 4 then null "
            f"when k % 3 = 0 then array({_ref('Location', '\'loc-x\', o_custkey')}) "
            f"else transform(sequence(0, k % 3), i -> named_struct('reference', {places})) end",
            "code": f"array({_concept(repr(EXAMPLE + '/role-code'), 'o_orderstatus', 'concat(\'Status \', o_orderstatus)')})",
            "specialty": f"case substring(o_orderpriority, 1, 1) when '1' then array({concept.format(nucc + ', ' + other)}) "
            f"when '2' then array({concept.format(nucc)}) when '5' then null "
            f"else array({concept.format(other)}, {bare}) end",
            "telecom": "if(o_orderstatus = 'O', array(named_struct('value', concat('555-', k))), null)",
            "endpoint": "if(o_orderstatus = 'F', array(named_struct('reference', concat('Endpoint/ep-', k))), null)",
            "availableTime": "case when k % 3 = 0 then array(named_struct('daysOfWeek', "
            "if(k % 2 = 0, array('mon', 'wed'), array('tue')), 'allDay', cast(null as boolean))) "
            "when a and k % 3 = 1 then array(named_struct('daysOfWeek', cast(null as array<string>), 'allDay', true)) end",
            "notAvailable": "if(k % 11 = 0, array(named_struct('description', 'holiday')), null)",
            "extension": f"case when not a then null when k % 12 = 0 then array({new_patients}, {network}) "
            f"when k % 4 = 0 then array({new_patients}) when k % 6 = 0 then array({network}) "
            f"when k % 6 = 1 then array({rating}) end",
        },
    )


def _locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _render(
        _rows(spark, sf_dir, "part").withColumnRenamed("p_partkey", "k"),
        "locations",
        "Location",
        "concat('loc-', k)",
        {
            "status": "if(p_size % 10 = 0, 'suspended', 'active')",
            "name": "if(k % 15 = 0, null, p_name)",
            "type": f"array({_concept(repr(EXAMPLE + '/location-type'), 'p_type')})",
            "telecom": "if(a and k % 2 = 0, array(named_struct('value', concat('555-', k))), null)",
            "address": "if(a or k % 2 = 0, named_struct('city', p_brand), null)",
            "position": "if(p_size > 10, named_struct('longitude', p_size, 'latitude', p_size), null)",
            "managingOrganization": f"if(k % 9 = 0, null, {_ref('Organization', '\'org-\', k % 130')})",
            "hoursOfOperation": "if(k % 7 = 0, array(named_struct('allDay', true)), null)",
            "extension": f"case when a and k % 10 = 0 then array({_extension('accessibility')}) "
            f"when a and k % 10 = 1 then array({_extension('region')}) end",
        },
    )


def _endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _render(
        _rows(spark, sf_dir, "events").withColumnRenamed("event_id", "k"),
        "endpoints",
        "Endpoint",
        "concat('ep-', k)",
        {
            "meta": "named_struct('lastUpdated', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\"))",
            "status": "if(event_type = 'error', null, event_type)",
            "connectionType": f"if(event_type = 'signup', null, named_struct('system', '{EXAMPLE}/connection', 'code', event_type))",
            "name": "if(k % 3 = 0, concat('Endpoint ', k), null)",
            "managingOrganization": f"if(k % 9 = 0, null, {_ref('Organization', '\'org-\', user_id % 110')})",
            "payloadType": "if(k % 2 = 0, array(named_struct('text', 'any')), null)",
            "address": "if(value >= 50, concat('https://ep.example.org/', k), null)",
        },
    )


def _organization_affiliations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    # The lines of an order meet in tasks of a fixed size, which also render its document.
    per_order = (
        lines.select(F.col("l_orderkey").alias("k"), "l_suppkey", "l_returnflag")
        .repartition(tasks(lines, LINES), "k")
        .groupBy("k")
        .agg(F.min("l_suppkey").alias("s"), F.min("l_returnflag").alias("flag"))
    )
    return _render(
        per_order,
        "organization_affiliations",
        "OrganizationAffiliation",
        "concat('aff-', k)",
        {
            "active": "if(a, true, null)",
            "organization": _ref("Organization", "'org-', s"),
            "participatingOrganization": f"if(k % 10 = 3, null, {_ref('Organization', '\'org-\', s + 7')})",
            "code": f"array({_concept(repr(EXAMPLE + '/affiliation-role'), 'flag', 'concat(\'Flag \', flag)')})",
            "specialty": "if(k % 6 = 0, array(named_struct('text', 'any')), null)",
            "location": "if(k % 4 = 0, array(named_struct('reference', concat('Location/loc-', k))), null)",
            "endpoint": "if(k % 10 = 0, array(named_struct('reference', concat('Endpoint/ep-', k))), null)",
        },
    )


RENDERERS = {
    "organizations": _organizations,
    "organization_affiliations": _organization_affiliations,
    "practitioners": _practitioners,
    "practitioner_roles": _practitioner_roles,
    "locations": _locations,
    "endpoints": _endpoints,
}


def raw_documents(spark: SparkSession, sf_dir: str, resource: str) -> DataFrame:
    """(source_dataset, fhir_id, raw_json) of one resource."""
    return RENDERERS[resource](spark, sf_dir).select("source_dataset", "fhir_id", "raw_json")


def documents(spark: SparkSession, sf_dir: str, resource: str) -> DataFrame:
    """The documents with their parsed form."""
    return raw_documents(spark, sf_dir, resource).withColumn("doc", F.parse_json("raw_json"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run log: one run per order priority, price band and year, sized by its orders."""
    orders = _table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("resource_type"),
        F.when(F.col("o_totalprice") >= 250000, DATASET_B).otherwise(DATASET_A).alias("source_dataset"),
        F.year("o_orderdate").alias("year"),
        "o_orderdate",
        "o_orderstatus",
        "o_custkey",
    )
    runs = orders.groupBy("resource_type", "source_dataset", "year").agg(
        F.max("o_orderdate").alias("run_at"),
        (F.sum("o_custkey") * 1000).alias("compressed_size_bytes"),
        (F.count(F.lit(1)) * 7).alias("download_ms"),
        F.expr("sum(o_custkey) div 100").alias("process_ms"),
        F.count(F.lit(1)).alias("record_count"),
        F.count_if(F.col("o_orderstatus") == "P").alias("error_count"),
    )
    return runs.select(
        "run_at",
        F.concat_ws("_", "resource_type", "year").alias("source_file"),
        "source_dataset",
        "resource_type",
        F.when(F.col("source_dataset") == DATASET_A, "zst").otherwise("gz").alias("compression"),
        "compressed_size_bytes",
        "download_ms",
        "process_ms",
        (F.col("download_ms") + F.col("process_ms")).alias("total_ms"),
        "record_count",
        "error_count",
        (F.col("record_count") / (F.nullif("process_ms", F.lit(0)) / 1000.0)).alias("records_per_sec"),
    )
