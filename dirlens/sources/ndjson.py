"""Newline-delimited JSON deliveries: plain, gzip, bzip2 or zstd text, one document per line."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dirlens.schema import DATASETS, RESOURCES
from dirlens.sources.partitions import spread

# Position of a line: later deliveries win, then files with the greater name, later blocks and later lines.
POSITION = ["delivery", "source_path", "block_start", "line_id"]

COMPRESSIONS = {"zst": "zst", "gz": "gz", "bz2": "bz2"}


@dataclass(frozen=True)
class Delivery:
    """A file, folder or glob of NDJSON text of one resource from one dataset."""

    path: str
    dataset: str
    resource: str

    @property
    def compression(self) -> str:
        return COMPRESSIONS.get(self.path.rstrip("/").rsplit(".", 1)[-1], "none")

    @property
    def name(self) -> str:
        return self.path.rstrip("/").rsplit("/", 1)[-1]


def manifest(
    root: str, suffix: str = "ndjson.zst", datasets: Sequence[str] = DATASETS, resources: Sequence[str] = RESOURCES
) -> list[list[Delivery]]:
    """The deliveries ``<root>/<dataset>/<resource>.<suffix>``, one group per resource."""
    return [[Delivery(f"{root}/{ds}/{r}.{suffix}", ds, r) for ds in datasets] for r in resources]


def with_origin(lines: DataFrame) -> DataFrame:
    """Text lines with the file and the file split they come from."""
    return lines.select(
        "value",
        F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_path").alias("source_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.unix_micros("_metadata.file_modification_time").alias("modified"),
    )


def numbered(lines: DataFrame) -> DataFrame:
    """Lines with a number that rises within a file split, on enough tasks to decode them.

    The number is fixed before anything moves the rows to other tasks.
    """
    return spread(lines.withColumn("line_id", F.monotonically_increasing_id()))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a delivery with their position."""
    return numbered(with_origin(spark.read.text(path)))


def _problem(value: Column, doc: Column) -> Column:
    identity = F.try_variant_get(doc, "$.id", "variant")
    usable = (F.schema_of_variant(identity) == "STRING") & (F.try_variant_get(doc, "$.id", "string") != "")
    return (
        F.when(F.trim(value) == "", F.lit("blank"))
        .when(doc.isNull(), F.lit("not a document"))
        .when(~F.coalesce(usable, F.lit(False)), F.lit("no id"))
    )


def parse_lines(lines: DataFrame, dataset: str, delivery: Column) -> DataFrame:
    """Lines with key, lineage and position; ``problem`` names why a line is no document.

    ``delivery`` orders deliveries: their place in a list, or the time of a file that arrived.
    A line that cannot be parsed, or is beyond the size a VARIANT holds, becomes a NULL document
    and does not stop the job. The parsed form is not carried on: parsing the surviving lines
    once more costs less than writing it twice.
    """
    return lines.withColumn("doc", F.try_parse_json("value")).select(
        F.try_variant_get("doc", "$.id", "string").alias("fhir_id"),
        F.col("value").alias("raw_json"),
        "source_file",
        F.current_timestamp().alias("ingested_at"),
        F.lit(dataset).alias("source_dataset"),
        delivery.cast("long").alias("delivery"),
        *POSITION[1:],
        _problem(F.col("value"), F.col("doc")).alias("problem"),
    )


def size_in_bytes(spark: SparkSession, path: str) -> int:
    """Stored size of a delivery; only file lengths are read."""
    files = spark.read.format("binaryFile").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
