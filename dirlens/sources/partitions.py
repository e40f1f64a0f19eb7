"""Enough tasks for work that is heavy per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table that one task renders, parses and sorts as documents.
ROWS = 50_000


def spread(scan: DataFrame) -> DataFrame:
    """A file scan with at least one partition per core.

    Documents cost far more to decode than to move, and a compressed text file or a small
    Parquet file is read by one task. A scan that already has enough partitions, as any large
    splittable input does, is returned as it is and gets no extra shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def tasks(scan: DataFrame, rows: int = ROWS) -> int:
    """Tasks of at most ``rows`` rows each, one per core at least. Of Parquet files only the footers are read."""
    return max(scan.sparkSession.sparkContext.defaultParallelism, -(-scan.count() // rows))


def bounded(scan: DataFrame, rows: int = ROWS) -> DataFrame:
    """A Parquet scan in tasks of about ``rows`` rows, so that a larger table has more tasks and not larger ones.

    The size of a file split says little here: a row of a few bytes becomes a document of a thousand. Rows are dealt out by
    their position in the scan, so that neither repeated nor NULL keys meet in one task, and without a sort.
    """
    place = "spread by"
    return scan.withColumn(place, F.monotonically_increasing_id()).repartition(tasks(scan, rows), place).drop(place)
