"""Side-by-side comparison and identity-based merging of datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirlens.functions.elements import explode_elements
from dirlens.functions.measures import ratio
from dirlens.schema import DATASET_A, DATASET_B

DATASET = "source_dataset"


def dataset_comparison(
    report: DataFrame, metric: str, value: str, a: str = DATASET_A, b: str = DATASET_B, total: str = "TOTAL"
) -> DataFrame:
    """A long report as one line per metric with a column per dataset, their ratio, and a total line."""
    sums = report.rollup(metric).agg(
        F.sum(F.when(F.col(DATASET) == a, F.col(value))).alias("dataset_a"),
        F.sum(F.when(F.col(DATASET) == b, F.col(value))).alias("dataset_b"),
        F.grouping(metric).alias("is_total"),
    )
    return sums.orderBy("is_total", metric).select(
        F.when(F.col("is_total") == 1, F.lit(total)).otherwise(F.col(metric)).alias(metric),
        "dataset_a",
        "dataset_b",
        ratio(F.col("dataset_a"), F.col("dataset_b")).alias("ratio"),
    )


def _winner(value: str, rows: Column | None = None) -> Column:
    """The most recently updated document that has a value, then the greatest id: its dataset and id.

    Only names and times are compared. The values stay where they are until their document has won.
    """
    usable = F.col(f"has_{value}") if rows is None else F.col(f"has_{value}") & rows
    rank = F.struct(F.coalesce("last_updated", F.lit("")).alias("last_updated"), F.col("fhir_id"), F.col(DATASET).alias("dataset"))
    return F.max(F.when(usable, rank))


def _keyed(df: DataFrame, systems: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """A narrow row per document and identifier: which attributes it has, not their values."""
    wanted = F.filter("identifiers", lambda e: e["system"].isin(*systems) & e["value"].isNotNull())
    values = F.array_distinct(F.transform(wanted, lambda e: e["value"]))
    presence = [F.col(a).isNotNull().alias(f"has_{a}") for a in attributes]
    narrow = df.select(DATASET, "fhir_id", "last_updated", *presence, values.alias("npis"))
    return explode_elements(narrow, [DATASET, "fhir_id", "last_updated", *[f"has_{a}" for a in attributes]], F.col("npis"), "npi")


def _with_values(df: DataFrame, winners: DataFrame, keys: Sequence[str], others: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """``winners`` with the attributes' values from the documents that won them.

    A value is read once for each identity that it goes to, by a hash join whose table holds names only; values are neither sorted nor
    compared, and those that won nothing are not moved. ``winners`` has a column ``win_<attribute>`` for each
    attribute. Documents are unique by dataset and id.
    """
    won = F.posexplode(F.array(*(F.col(f"win_{a}") for a in attributes)))
    wins = winners.select(*keys, won.alias("attribute", "win")).filter("win is not null").select(
        *keys, "attribute", F.col("win.dataset").alias("win_dataset"), F.col("win.fhir_id").alias("win_id")
    )
    documents = df.select(F.col(DATASET).alias("win_dataset"), F.col("fhir_id").alias("win_id"), F.array(*attributes).alias("values"))
    values = documents.join(wins.hint("shuffle_hash"), ["win_dataset", "win_id"]).select(
        *keys, F.struct("attribute", F.get("values", F.col("attribute")).alias("value")).alias("found")
    )
    rows = winners.select(*keys, *others).unionByName(values, allowMissingColumns=True)
    found = rows.groupBy(*keys).agg(*(F.max(o).alias(o) for o in others), F.collect_list("found").alias("found"))

    def value(i: int) -> Column:
        return F.get(F.filter("found", lambda x: x["attribute"] == i), F.lit(0))["value"]

    return found.select(*keys, *others, *(value(i).alias(a) for i, a in enumerate(attributes)))


def consolidate(df: DataFrame, systems: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """One row per dataset and identifier value with the preferred value of each attribute."""
    winners = _keyed(df, systems, attributes).groupBy(DATASET, "npi").agg(
        F.count(F.lit(1)).alias("owners"), F.min("fhir_id").alias("fhir_id"), *(_winner(a).alias(f"win_{a}") for a in attributes)
    )
    return _with_values(df, winners, [DATASET, "npi"], ["owners", "fhir_id"], attributes)


def reconcile(
    df: DataFrame,
    systems: Sequence[str],
    name: str,
    attributes: Sequence[str],
    base: str = DATASET_B,
    enrich: str = DATASET_A,
) -> DataFrame:
    """The identities of ``base`` with the attributes ``enrich`` knows for the same identifier.

    Both datasets are merged in one aggregate on the identifier, which replaces consolidating
    each of them and joining the results.
    """
    from_base, from_enrich = F.col(DATASET) == base, F.col(DATASET) == enrich
    every = [name, *attributes]
    winners = (
        _keyed(df, systems, every)
        .groupBy("npi")
        .agg(
            F.min(F.when(from_base, F.col("fhir_id"))).alias("fhir_id"),
            F.count_if(from_enrich).alias("enriching_records"),
            *(F.coalesce(_winner(a, from_base), _winner(a, from_enrich)).alias(f"win_{a}") for a in every),
        )
        .filter("fhir_id is not null")
    )
    found = _with_values(df, winners, ["npi"], ["fhir_id", "enriching_records"], every)
    return found.select("npi", "fhir_id", name, "enriching_records", *attributes)
