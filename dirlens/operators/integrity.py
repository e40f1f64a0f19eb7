"""Do references resolve within their dataset?

A reference and the document it names meet in one aggregate on (dataset, id) instead of a join:
references bring a count, documents bring a flag. Partial aggregation folds a heavily referenced
id before the exchange, neither side has to fit in memory, and several reference fields to the
same target share the pass.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirlens.functions.measures import percent, rows
from dirlens.functions.references import reference_format, reference_host, reference_id
from dirlens.operators.skew import ROWS, exists_flag
from dirlens.sources.partitions import tasks

DATASET = "source_dataset"
KEY = [DATASET, "target_id"]


def resolve_references(
    source: DataFrame, fields: Mapping[str, tuple[str, str]], target: DataFrame, parse: str = "last"
) -> DataFrame:
    """Resolution counts per dataset for single-valued reference fields to one target table.

    ``fields`` maps a name to (presence flag, reference column). For each name the result has
    ``missing_``, ``present_``, ``resolved_``, ``unresolved_`` and ``pct_`` columns. A reference
    object without a ``reference`` member is present and unresolved.
    """
    first = next(iter(fields))
    edges = [
        F.struct(
            F.lit(name).alias("field"),
            reference_id(F.col(reference), parse).alias("target_id"),
            F.col(present).alias("present"),
        )
        for name, (present, reference) in fields.items()
    ]
    references = source.select(DATASET, F.inline(F.array(*edges)))
    nothing = {f"n_{name}": F.lit(0) for name in fields}
    refs = references.select(
        *KEY,
        (F.col("field") == first).cast("int").alias("n_rows"),
        *[((F.col("field") == n) & F.col("present")).cast("int").alias(f"n_{n}") for n in fields],
        F.lit(False).alias("exists"),
    )
    docs = target.select(
        DATASET,
        F.col("fhir_id").alias("target_id"),
        F.lit(0).alias("n_rows"),
        *[value.alias(name) for name, value in nothing.items()],
        F.lit(True).alias("exists"),
    )
    ids = refs.unionByName(docs).groupBy(*KEY).agg(
        F.sum("n_rows").alias("n_rows"),
        *[F.sum(f"n_{n}").alias(f"n_{n}") for n in fields],
        F.bool_or("exists").alias("exists"),
    )
    measures: list[Column] = [F.sum("n_rows").alias("total")]
    for name in fields:
        count = F.col(f"n_{name}")
        measures += [
            F.sum(count).alias(f"present_{name}"),
            F.sum(F.when(F.col("exists") & F.col("target_id").isNotNull(), count).otherwise(0)).alias(
                f"resolved_{name}"
            ),
        ]
    totals = ids.groupBy(DATASET).agg(*measures).filter("total > 0")
    columns = [F.col(DATASET), F.col("total")]
    for name in fields:
        present, resolved = F.col(f"present_{name}"), F.col(f"resolved_{name}")
        columns += [
            (F.col("total") - present).alias(f"missing_{name}"),
            present,
            resolved,
            (present - resolved).alias(f"unresolved_{name}"),
            percent(resolved, present).alias(f"pct_{name}"),
        ]
    return totals.select(*columns).orderBy(DATASET)


def resolve_reference_lists(
    source: DataFrame, present: str, references: str, target: DataFrame, parse: str = "last"
) -> DataFrame:
    """Resolution of a multi-valued reference field.

    A row counts as resolved when at least one of its references does; the single references
    are counted as well. Rows without references travel along with a NULL target. The links of a row meet again in as many
    tasks as its table needs.
    """
    links = source.select(
        DATASET, "fhir_id", present, F.posexplode_outer(references).alias("position", "reference")
    ).select(
        DATASET,
        "fhir_id",
        F.col(present).alias("present"),
        F.col("position").isNotNull().alias("is_reference"),
        reference_id(F.col("reference"), parse).alias("target_id"),
    )
    documents = target.select(DATASET, F.col("fhir_id").alias("target_id"))
    per_row = (
        exists_flag(links, documents, on=KEY, spread_by="fhir_id", flag="found")
        .repartition(tasks(source, ROWS), DATASET, "fhir_id")
        .groupBy(DATASET, "fhir_id")
        .agg(
            F.bool_or("present").alias("present"),
            F.bool_or("found").alias("found"),
            F.count_if("is_reference").alias("n_references"),
            F.count_if("found").alias("resolved_references"),
        )
    )
    return (
        per_row.groupBy(DATASET)
        .agg(
            rows().alias("total"),
            F.count_if(~F.col("present")).alias("missing"),
            F.count_if("present").alias("present"),
            F.count_if("found").alias("resolved"),
            F.sum("n_references").alias("n_references"),
            F.sum("resolved_references").alias("resolved_references"),
        )
        .orderBy(DATASET)
    )


def reference_edges(resource: str, df: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """References of a table as (resource, dataset, id, field, reference) rows, NULL ones dropped."""
    edges = [F.struct(F.lit(n).alias("field"), F.col(c).alias("reference")) for n, c in fields.items()]
    return df.select(
        F.lit(resource).alias("resource_type"), DATASET, "fhir_id", F.inline(F.array(*edges))
    ).filter("reference is not null")


def reference_formats(edges: list[DataFrame]) -> DataFrame:
    """References per resource, field, format and host."""
    return (
        reduce(DataFrame.unionByName, edges)
        .select(
            "resource_type",
            DATASET,
            "field",
            reference_format(F.col("reference")).alias("format"),
            reference_host(F.col("reference")).alias("host"),
        )
        .groupBy("resource_type", DATASET, "field", "format", "host")
        .agg(rows().alias("occurrences"))
        .orderBy("resource_type", DATASET, "field", F.desc("occurrences"), "format", F.asc_nulls_last("host"))
    )
