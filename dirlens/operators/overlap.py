"""What two datasets share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dirlens.functions.elements import explode_elements
from dirlens.schema import DATASET_A, DATASET_B

DATASET = "source_dataset"


def _membership(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """One row per distinct key: how often it occurs on either side.

    A single exchange with partial aggregation. No join, no distinct expansion, and a key that
    holds a large share of the rows is already folded before it is sent.
    """
    return df.groupBy(key).agg(
        F.count_if(F.col(DATASET) == a).alias("in_a"), F.count_if(F.col(DATASET) == b).alias("in_b")
    )


def key_overlap(
    df: DataFrame, label: str, key: str = "fhir_id", a: str = DATASET_A, b: str = DATASET_B
) -> DataFrame:
    """Rows per dataset, distinct keys in both, and rows whose key is on one side only."""
    has_a, has_b = F.col("in_a") > 0, F.col("in_b") > 0
    return _membership(df, key, a, b).agg(
        F.lit(label).alias("resource_type"),
        F.coalesce(F.sum("in_a"), F.lit(0)).alias("dataset_a_total"),
        F.coalesce(F.sum("in_b"), F.lit(0)).alias("dataset_b_total"),
        F.count_if(has_a & has_b).alias("in_both"),
        F.coalesce(F.sum(F.when(~has_b, F.col("in_a"))), F.lit(0)).alias("only_in_a"),
        F.coalesce(F.sum(F.when(~has_a, F.col("in_b"))), F.lit(0)).alias("only_in_b"),
    )


def identifier_values(df: DataFrame, systems: Sequence[str], alias: str = "npi") -> DataFrame:
    """One row per document and distinct identifier value of ``systems``, NULL values included."""
    wanted = F.filter("identifiers", lambda e: e["system"].isin(*systems))
    values = F.array_distinct(F.transform(wanted, lambda e: e["value"]))
    return explode_elements(df, [DATASET, "fhir_id"], values, alias)


def value_overlap(
    df: DataFrame,
    systems: Sequence[str],
    a: str = DATASET_A,
    b: str = DATASET_B,
    strict_not_in: bool = False,
) -> DataFrame:
    """Distinct identifier values per dataset, shared, and on one side only.

    NULL values are left out. ``strict_not_in=True`` gives what SQL ``NOT IN`` gives instead:
    one NULL on the other side makes the "only" count zero.
    """
    keys = _membership(identifier_values(df, systems).select(DATASET, "npi"), "npi", a, b)
    real = F.col("npi").isNotNull()
    has_a, has_b = real & (F.col("in_a") > 0), real & (F.col("in_b") > 0)
    only_a, only_b = F.count_if(has_a & ~has_b), F.count_if(has_b & ~has_a)
    if strict_not_in:
        null_in_a = F.count_if(~real & (F.col("in_a") > 0)) > 0
        null_in_b = F.count_if(~real & (F.col("in_b") > 0)) > 0
        only_a = F.when(null_in_b, F.lit(0)).otherwise(only_a)
        only_b = F.when(null_in_a, F.lit(0)).otherwise(only_b)
    return keys.agg(
        F.count_if(has_a).alias("dataset_a_unique_npis"),
        F.count_if(has_b).alias("dataset_b_unique_npis"),
        F.count_if(has_a & has_b).alias("npis_in_both"),
        only_a.alias("only_in_a"),
        only_b.alias("only_in_b"),
    )


def identifier_fragmentation(df: DataFrame, systems: Sequence[str]) -> DataFrame:
    """How many documents share one identifier value, per dataset.

    ``identifier_values`` lists a value once per document and (dataset, id) is the table key,
    so a plain count is the number of owners.
    """
    owners = (
        identifier_values(df, systems)
        .filter("npi is not null")
        .groupBy(DATASET, "npi")
        .agg(F.count(F.lit(1)).alias("owners"))
    )
    return (
        owners.groupBy(DATASET)
        .agg(
            F.count(F.lit(1)).alias("distinct_values"),
            F.sum("owners").alias("value_owner_pairs"),
            F.count_if(F.col("owners") > 1).alias("values_with_many_owners"),
            F.max("owners").alias("max_owners"),
            F.round(F.avg("owners"), 2).alias("avg_owners"),
        )
        .orderBy(DATASET)
    )
