"""Depth of a parent hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dirlens.functions.references import reference_id
from dirlens.schema import HIERARCHY_DEPTH_LIMIT

DATASET = "source_dataset"


def _doubled(jump: DataFrame) -> DataFrame:
    """Jumps of twice as many steps; a chain that ends earlier keeps the steps that it has, and leads nowhere."""
    onward = jump.select(DATASET, F.col("parent_id").alias("next_id"), F.col("next_id").alias("far_id"), F.col("step").alias("more"))
    far = jump.join(onward, [DATASET, "next_id"], "left")
    # The rebalancing ends in an exchange, which both sides of the next doubling reuse.
    return far.select(
        DATASET, "parent_id", F.col("far_id").alias("next_id"), (F.col("step") + F.coalesce("more", F.lit(0))).alias("step")
    ).filter("parent_id is not null").hint("rebalance")


def chain_lengths(
    df: DataFrame,
    present: str = "has_partOf",
    reference: str = "parent_ref",
    parse: str = "segment2",
    max_depth: int = HIERARCHY_DEPTH_LIMIT,
) -> DataFrame:
    """How many documents sit below a chain of each length: (dataset, depth, documents).

    A document with a parent has depth 1, one more for each further parent that itself has a
    parent, up to ``max_depth``, where cycles end too. The documents are not followed one by
    one: they are counted per parent, and each count moves on by jumps of 1, 2, 4, 8, ... parents, those whose sum
    is ``max_depth`` - 1. A jump is found by joining the jumps of half its length to themselves. Leaves of the
    hierarchy, most of its documents, take part in the first count only. Finished chains stay in
    the frame under a NULL parent, folded to one row per dataset and depth.
    """
    children = df.filter(F.col(present)).select(
        DATASET, "fhir_id", reference_id(F.col(reference), parse).alias("parent_id")
    )
    level = children.groupBy(DATASET, "parent_id").agg(
        F.lit(1).alias("depth"), F.count(F.lit(1)).alias("documents")
    )
    # Only documents that are parents themselves can be visited: one pass over all, then few.
    jump = children.select(
        DATASET, F.col("fhir_id").alias("parent_id"), F.col("parent_id").alias("next_id"), F.lit(1).alias("step")
    ).join(level.select(DATASET, "parent_id"), [DATASET, "parent_id"], "left_semi").filter("parent_id is not null").hint("rebalance")
    left = max_depth - 1
    while left:
        if left & 1:
            level = (
                level.join(jump, [DATASET, "parent_id"], "left")
                .select(
                    DATASET,
                    F.col("next_id").alias("parent_id"),
                    (F.col("depth") + F.coalesce("step", F.lit(0))).alias("depth"),
                    "documents",
                )
                .groupBy(DATASET, "parent_id", "depth")
                .agg(F.sum("documents").alias("documents"))
            )
        left >>= 1
        if left:
            jump = _doubled(jump)
    return level.groupBy(DATASET, "depth").agg(F.sum("documents").alias("documents"))


def hierarchy_depth(
    df: DataFrame, parse: str = "segment2", max_depth: int = HIERARCHY_DEPTH_LIMIT, with_limit: bool = False
) -> DataFrame:
    """Largest depth and mean depth over all (document, ancestor step) pairs.

    ``with_limit`` adds the number of documents whose chain was cut at ``max_depth`` or ends
    exactly there.
    """
    depth, documents = F.col("depth"), F.col("documents")
    extra = [F.sum(F.when(depth == max_depth, documents).otherwise(0)).alias("at_limit")] if with_limit else []
    return (
        chain_lengths(df, parse=parse, max_depth=max_depth)
        .groupBy(DATASET)
        .agg(
            F.max(depth).cast("long").alias("max_hierarchy_depth"),
            # A chain of length d contributes the steps 1..d.
            (F.sum(documents * depth * (depth + 1) / 2) / F.sum(documents * depth)).alias("avg_depth"),
            *extra,
        )
        .orderBy(DATASET)
    )
