"""Reports over the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dirlens.functions.measures import megabytes, ratio, seconds
from dirlens.schema import DATASET_A, DATASET_B


def run_report(runs: DataFrame) -> DataFrame:
    """Size, duration and throughput of each run."""
    return runs.orderBy("resource_type", "source_dataset").select(
        "source_dataset",
        "resource_type",
        "compression",
        "record_count",
        "error_count",
        megabytes(F.col("compressed_size_bytes")).alias("compressed_size_mb"),
        seconds(F.col("download_ms")).alias("download_sec"),
        seconds(F.col("process_ms")).alias("process_sec"),
        seconds(F.col("total_ms")).alias("total_sec"),
        F.round("records_per_sec", 0).alias("records_per_sec"),
    )


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last run of each resource and dataset."""
    every = F.struct(*[F.col(c) for c in runs.columns])
    return (
        runs.groupBy("resource_type", "source_dataset")
        .agg(F.max_by(every, F.struct("run_at", "source_file")).alias("run"))
        .select("run.*")
    )


def run_compare(
    runs: DataFrame, a: str = DATASET_A, b: str = DATASET_B, latest_only: bool = True
) -> DataFrame:
    """Runs of two datasets side by side.

    Compares the last runs. Without ``latest_only`` every run of ``a`` meets every run of ``b`` of
    the same resource, so reruns multiply the lines.
    """
    chosen = latest_runs(runs) if latest_only else runs

    def side(label: str, prefix: str) -> DataFrame:
        return chosen.filter(F.col("source_dataset") == label).select(
            "resource_type",
            F.col("compressed_size_bytes").alias(f"{prefix}_bytes"),
            megabytes(F.col("compressed_size_bytes")).alias(f"{prefix}_mb"),
            F.col("record_count").alias(f"{prefix}_records"),
            seconds(F.col("process_ms")).alias(f"{prefix}_process_sec"),
        )

    return (
        side(a, "dataset_a")
        .join(side(b, "dataset_b"), "resource_type")
        .select(
            "resource_type",
            "dataset_a_mb",
            "dataset_b_mb",
            ratio(F.col("dataset_a_bytes"), F.col("dataset_b_bytes")).alias("size_ratio_a_over_b"),
            "dataset_a_records",
            "dataset_b_records",
            "dataset_a_process_sec",
            "dataset_b_process_sec",
        )
        .orderBy("resource_type")
    )


def run_totals(runs: DataFrame) -> DataFrame:
    """Records, errors and time per dataset."""
    return (
        runs.groupBy("source_dataset")
        .agg(
            F.sum("record_count").alias("records"),
            F.sum("error_count").alias("errors"),
            F.sum("total_ms").alias("total_ms"),
        )
        .orderBy("source_dataset")
    )
