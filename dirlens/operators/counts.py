"""Row counts, value counts and freshness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dirlens.functions.elements import explode_elements
from dirlens.functions.measures import rows
from dirlens.schema import DATASETS

DATASET = "source_dataset"


def record_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per resource and dataset."""
    parts = [
        df.groupBy(DATASET).agg(rows().alias("record_count"))
        .select(F.lit(name).alias("resource_type"), DATASET, "record_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts).orderBy("resource_type", DATASET)


def value_counts(
    df: DataFrame,
    fields: Mapping[str, Column | str],
    elements: Column | str | None = None,
    limit: int | None = None,
    per_dataset: int | None = None,
    order: str = "occurrences",
    present: str | None = None,
) -> DataFrame:
    """Occurrences of each combination of ``fields`` per dataset, most frequent first.

    ``elements`` is an array that is exploded first; fields may then refer to ``element``.
    ``present`` is a flag of the rows that count, all of them by default. The
    aggregate combines on the map side, so a value that fills a third of all rows reaches the
    exchange as one row per task. ``limit`` keeps the first rows of the whole report and
    ``per_dataset`` the first of each dataset. Ties are broken by the field values, NULL last.
    """
    if elements is not None:
        df = explode_elements(df, [DATASET], elements, "element")
    named = {n: (F.col(f) if isinstance(f, str) else f) for n, f in fields.items()}
    counted = (
        df.select(DATASET, *[f.alias(n) for n, f in named.items()], *([present] if present else []))
        .groupBy(DATASET, *named)
        .agg((F.count_if(present) if present else rows()).alias("occurrences"))
    )
    if present:
        counted = counted.filter("occurrences > 0")
    values = [F.asc_nulls_last(n) for n in named]
    frequency = [] if order == "value" else [F.desc("occurrences")]
    if per_dataset is not None:
        rank = F.row_number().over(Window.partitionBy(DATASET).orderBy(*frequency, *values))
        counted = counted.withColumn("position", rank).filter(F.col("position") <= per_dataset).drop("position")
    counted = counted.orderBy(DATASET, *frequency, *values)
    return counted if limit is None else counted.limit(limit)


def freshness(
    tables: Mapping[str, DataFrame],
    column: str = "last_updated",
    datasets: Sequence[str] = DATASETS,
    typed: bool = False,
) -> DataFrame:
    """Rows with a timestamp, and the earliest and latest one, per resource and dataset.

    Text timestamps compare lexicographically, as text; ``typed=True`` parses them, so that
    offsets and precisions order correctly. For the named ``datasets`` the extremes are taken in
    one global aggregate per table: grouping would sort all rows, since text has no fixed-width
    aggregation buffer. Any other dataset is grouped the plain way; tables partitioned by dataset
    have nothing to read for that.
    """
    stamp = F.try_to_timestamp(F.col(column)) if typed else F.col(column)

    def others(name: str, df: DataFrame) -> DataFrame:
        return (
            df.filter(~F.col(DATASET).isin(*datasets))
            .select(DATASET, stamp.alias("stamp"))
            .groupBy(DATASET)
            .agg(
                F.count("stamp").alias("has_last_updated"),
                F.min("stamp").alias("earliest"),
                F.max("stamp").alias("latest"),
            )
            .select(F.lit(name).alias("resource_type"), "*")
        )

    def named(name: str, df: DataFrame) -> DataFrame:
        def measures(label: str) -> Column:
            mine = F.when(F.col(DATASET) == label, F.col("stamp"))
            return F.struct(
                F.lit(name).alias("resource_type"),
                F.lit(label).alias(DATASET),
                F.count_if(F.col(DATASET) == label).alias("records"),
                F.count(mine).alias("has_last_updated"),
                F.min(mine).alias("earliest"),
                F.max(mine).alias("latest"),
            )

        return (
            df.select(DATASET, stamp.alias("stamp"))
            .agg(F.array(*[measures(label) for label in datasets]).alias("lines"))
            .select(F.inline("lines"))
            .filter("records > 0")
            .drop("records")
        )

    parts = [part(name, df) for name, df in tables.items() for part in (named, others)]
    return reduce(DataFrame.unionByName, parts).orderBy("resource_type", DATASET)
