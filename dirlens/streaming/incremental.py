"""Deliveries that arrive file by file, picked up once each."""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from dirlens.sources.ndjson import Delivery, numbered, parse_lines, size_in_bytes, with_origin
from dirlens.sources.store import Staged, Store

LINES = StructType([StructField("value", StringType())])


def ingest_new_files(
    store: Store, folder: str, dataset: str, resource: str, checkpoint: str, files_per_batch: int | None = None
) -> None:
    """Load all files that appeared in ``folder`` since the last call, then stop.

    The checkpoint remembers finished files. Lines that are no documents are quarantined, and each file
    gets a row in the run log. A batch that is repeated after a failure merges the same documents
    again and replaces its own rejects and log rows, which changes nothing. A later batch wins
    over an earlier one, within a batch the newer file.
    """
    load = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    reader = store.spark.readStream.schema(LINES).format("text")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = with_origin(reader.load(folder))

    def merge(batch: DataFrame, batch_id: int) -> None:
        # The batch is read several times; a written copy keeps positions and parsing fixed.
        start, staged = time.monotonic(), f"{checkpoint}/staged"
        parse_lines(numbered(batch), dataset, F.col("modified")).write.mode("overwrite").parquet(staged)
        rows = store.spark.read.parquet(staged)
        # One row per file, as many as the log gets.
        files = rows.groupBy("source_path").agg(
            F.count_if(F.col("problem").isNull()).alias("records"),
            F.count_if(F.col("problem") == "blank").alias("blanks"),
            F.count_if(F.col("problem") != "blank").alias("errors"),
        ).collect()
        spent = round((time.monotonic() - start) * 1000)
        found = [
            Staged(
                Delivery(f["source_path"], dataset, resource), staged, size_in_bytes(store.spark, f["source_path"]),
                f["records"], f["errors"], f["blanks"], spent, spent,
            )
            for f in files
        ]
        if found:
            store.load_staged(rows, found, resource, f"{load}-{batch_id}")

    query = (
        lines.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", f"{checkpoint}/progress")
        .foreachBatch(merge)
        .start()
    )
    query.awaitTermination()
