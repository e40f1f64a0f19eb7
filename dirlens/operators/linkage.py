"""Reports that link entities with the documents that refer to them.

Entities and links meet in one aggregate on (dataset, entity id), as in ``integrity``: a single
exchange with map-side folding, so an entity with very many links costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirlens.functions.measures import percent, rows

DATASET = "source_dataset"
KEY = [DATASET, "entity_id"]


def _meet(
    entities: DataFrame, own: Mapping[str, Column], links: DataFrame, entity_id: Column, linked: Mapping[str, Column]
) -> DataFrame:
    """One row per entity: its own flags, and each link flag true when any link has it.

    Links without an id fold into one row per task under a NULL key, which is no entity.
    """
    sides = [
        entities.select(
            DATASET,
            F.col("fhir_id").alias("entity_id"),
            F.lit(True).alias("is_entity"),
            F.lit(False).alias("is_linked"),
            *[flag.alias(n) for n, flag in own.items()],
            *[F.lit(False).alias(n) for n in linked],
        ),
        links.select(
            DATASET,
            entity_id.alias("entity_id"),
            F.lit(False).alias("is_entity"),
            F.lit(True).alias("is_linked"),
            *[F.lit(False).alias(n) for n in own],
            *[flag.alias(n) for n, flag in linked.items()],
        ),
    ]
    flags = ["is_entity", "is_linked", *own, *linked]
    return (
        sides[0]
        .unionByName(sides[1])
        .groupBy(*KEY)
        .agg(*[F.bool_or(n).alias(n) for n in flags])
        .filter("is_entity")
    )


def linked_coverage(entities: DataFrame, keyed: Column, links: DataFrame, entity_id: Column) -> DataFrame:
    """Of the entities that satisfy ``keyed``: how many have at least one link."""
    met = _meet(entities, {"keyed": keyed}, links, entity_id, {}).filter("keyed")
    linked = F.count_if("is_linked")
    return (
        met.groupBy(DATASET)
        .agg(
            rows().alias("total_practitioners"),
            linked.alias("practitioners_with_role"),
            percent(linked, rows()).alias("pct_with_role"),
            (rows() - linked).alias("practitioners_without_role"),
        )
        .orderBy(DATASET)
    )


def directory_completeness(
    entities: DataFrame,
    own: Mapping[str, Column],
    links: DataFrame,
    entity_id: Column,
    linked: Mapping[str, Column],
    shares: Mapping[str, str],
    required: list[str],
) -> DataFrame:
    """Share of entities per own flag and per flag of any link, and of those with all ``required``."""
    met = _meet(entities, own, links, entity_id, linked)
    complete = F.expr(" and ".join(required))
    return (
        met.groupBy(DATASET)
        .agg(
            rows().alias("total_practitioners"),
            *[percent(F.count_if(flag), rows()).alias(name) for name, flag in shares.items()],
            percent(F.count_if(complete), rows()).alias("pct_directory_complete"),
        )
        .orderBy(DATASET)
    )


def fanout_distribution(links: DataFrame, present: str, entity_id: Column) -> DataFrame:
    """Minimum, maximum, mean, exact median and 1 / 2 / 3+ classes of links per entity.

    Links whose reference names no entity form one group, as any other key. The per-entity
    counts are reduced to a histogram first, which keeps the exact median small.
    """
    counted = (
        links.select(DATASET, entity_id.alias("entity_id"), present)
        .groupBy(*KEY)
        .agg(F.count_if(present).alias("n"))
        .filter("n > 0")
    )
    histogram = counted.groupBy(DATASET, "n").agg(rows().alias("entities"))
    n, entities = F.col("n"), F.col("entities")
    return (
        histogram.groupBy(DATASET)
        .agg(
            F.min(n).alias("min_roles"),
            F.max(n).alias("max_roles"),
            F.round(F.sum(n * entities) / F.sum(entities), 2).alias("avg_roles"),
            F.percentile(n, 0.5, entities).alias("median_roles"),
            F.coalesce(F.sum(F.when(n == 1, entities)), F.lit(0)).alias("practitioners_with_1_role"),
            F.coalesce(F.sum(F.when(n == 2, entities)), F.lit(0)).alias("practitioners_with_2_roles"),
            F.coalesce(F.sum(F.when(n >= 3, entities)), F.lit(0)).alias("practitioners_with_3plus_roles"),
        )
        .orderBy(DATASET)
    )
