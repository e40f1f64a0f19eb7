"""First records in key order, for spot checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DATASET = "source_dataset"


def sample_records(
    df: DataFrame, columns: Sequence[Column | str], n: int, per_dataset: bool = False
) -> DataFrame:
    """The first ``n`` records by (dataset, id), of the whole table or of each dataset.

    Each task keeps at most ``n`` rows (per dataset), so the full table is never sorted.
    """
    if not per_dataset:
        return df.orderBy(DATASET, "fhir_id").limit(n).select(*columns)
    rank = F.row_number().over(Window.partitionBy(DATASET).orderBy("fhir_id"))
    return (
        df.withColumn("position", rank)
        .filter(F.col("position") <= n)
        .orderBy(DATASET, "fhir_id")
        .select(*columns)
    )


def with_link_count(sample: DataFrame, links: DataFrame, entity_id: Column, alias: str) -> DataFrame:
    """A sample of fixed size with the number of links to each of its records.

    ``sample`` must come from ``sample_records``: its size is a parameter, not a share of the
    data, which is why its ids can be broadcast to filter the links before they are counted.
    """
    wanted = sample.select(DATASET, F.col("fhir_id").alias("entity_id"))
    counted = (
        links.select(DATASET, entity_id.alias("entity_id"))
        .join(F.broadcast(wanted), [DATASET, "entity_id"], "left_semi")
        .groupBy(DATASET, F.col("entity_id").alias("fhir_id"))
        .agg(F.count(F.lit(1)).alias(alias))
    )
    return (
        sample.join(F.broadcast(counted), [DATASET, "fhir_id"], "left")
        .withColumn(alias, F.coalesce(alias, F.lit(0)))
        .orderBy(DATASET, "fhir_id")
    )
