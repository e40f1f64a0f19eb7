"""Table layouts and the fixed values of the directory domain."""

from __future__ import annotations

from pyspark.sql import types as T

# Labels, code systems and URL patterns of the data model.
DATASET_A = "dataset-a"
DATASET_B = "dataset-b"
DATASETS = (DATASET_A, DATASET_B)

NPI_SYSTEM_A = "http://hl7.org/fhir/sid/us-npi"
NPI_SYSTEM_B = "http://terminology.hl7.org/NamingSystem/npi"
NPI_SYSTEMS = (NPI_SYSTEM_A, NPI_SYSTEM_B)
SSN_SYSTEM = "http://hl7.org/fhir/sid/us-ssn"
SPECIALTY_SYSTEM = "http://nucc.org/provider-taxonomy"

OVERSIZE_THRESHOLD = 100
HIERARCHY_DEPTH_LIMIT = 10

RESOURCES = (
    "organizations",
    "organization_affiliations",
    "practitioners",
    "practitioner_roles",
    "locations",
    "endpoints",
)

KEY = ["source_dataset", "fhir_id"]

RESOURCE_SCHEMA = T.StructType(
    [
        T.StructField("fhir_id", T.StringType(), False),
        T.StructField("raw_json", T.StringType(), False),
        T.StructField("doc", T.VariantType(), False),
        T.StructField("source_file", T.StringType(), False),
        T.StructField("ingested_at", T.TimestampType(), True),
        T.StructField("source_dataset", T.StringType(), False),
    ]
)

REJECTED_SCHEMA = T.StructType(
    [
        T.StructField("source_dataset", T.StringType(), False),
        T.StructField("source_file", T.StringType(), False),
        T.StructField("ingested_at", T.TimestampType(), True),
        T.StructField("problem", T.StringType(), False),
        T.StructField("n_bytes", T.LongType(), False),
        T.StructField("raw_json", T.StringType(), False),
    ]
)

RUN_SCHEMA = T.StructType(
    [
        T.StructField("run_at", T.TimestampType(), True),
        T.StructField("source_file", T.StringType(), False),
        T.StructField("source_dataset", T.StringType(), False),
        T.StructField("resource_type", T.StringType(), False),
        T.StructField("compression", T.StringType(), False),
        T.StructField("compressed_size_bytes", T.LongType(), True),
        T.StructField("download_ms", T.LongType(), True),
        T.StructField("process_ms", T.LongType(), False),
        T.StructField("total_ms", T.LongType(), False),
        T.StructField("record_count", T.LongType(), False),
        T.StructField("error_count", T.LongType(), False),
        T.StructField("blank_count", T.LongType(), False),
        T.StructField("duplicate_count", T.LongType(), False),
        T.StructField("records_per_sec", T.DoubleType(), True),
    ]
)
