"""Times the whole path at one scale: load text deliveries, extract features, run every report.

The text is derived from the test tables and written first, which is not timed. Reports run over
the stored feature tables, once to warm up and once for the clock. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F

from dirlens.plans.directory import Directory
from dirlens.plans.reports import REPORTS
from dirlens.schema import DATASETS, RESOURCES
from dirlens.session import local_session
from dirlens.sources import derived
from dirlens.sources.ndjson import manifest
from dirlens.sources.store import Store

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def write_text(spark, root: str) -> int:
    """The deliveries as gzip text, one folder per resource and dataset; returns the documents."""
    total = 0
    for resource in RESOURCES:
        rows = derived.raw_documents(spark, SF_DIR, resource).cache()
        total += rows.count()
        for dataset in DATASETS:
            rows.filter(F.col("source_dataset") == dataset).select("raw_json").write.option(
                "compression", "gzip"
            ).text(f"{root}/{dataset}/{resource}.ndjson")
        rows.unpersist()
    return total


def clock(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = local_session(CPUS, shuffle_partitions=int(CPUS) if CPUS.isdigit() else 8, app="dirlens-bench", memory="12g")
    with tempfile.TemporaryDirectory(prefix="run-", dir="/tmp") as root:
        documents = write_text(spark, f"{root}/text")
        store = Store(spark, f"{root}/store")
        ingest = {}
        for group in manifest(f"{root}/text", "ndjson"):
            ingest[group[0].resource] = clock(lambda g=group: store.ingest(g))
        features = clock(lambda: [store.write_features(r) for r in RESOURCES])
        stored = store.directory()
        directory = Directory(store.features, store.documents, lambda: derived.run_log(spark, SF_DIR))
        stored.runs.count()
        queries = {}
        for name, report in REPORTS.items():
            report(directory).collect()
            queries[name] = clock(lambda r=report: r(directory).collect())
        ingest_sec = round(sum(ingest.values()), 3)
        print(
            json.dumps(
                {
                    "metric": "all_reports_warm_seconds",
                    "value": round(sum(queries.values()), 3),
                    "unit": "sec",
                    "queries": queries,
                    "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                    "documents": documents,
                    "ingest_sec": ingest_sec,
                    "ingest_sec_by_resource": ingest,
                    "ingest_records_per_sec": round(documents / ingest_sec),
                    "features_sec": features,
                }
            )
        )
    spark.stop()


if __name__ == "__main__":
    main()
