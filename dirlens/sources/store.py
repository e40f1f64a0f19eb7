"""The stored directory: document tables, feature tables, rejected lines and the run log.

All tables are plain Parquet below one root. A load appends: it writes its own documents, partitioned by ``source_dataset``, their
features, and a narrow table of the keys that it takes over from earlier loads, which are then retired there. Nothing
that is stored is read but keys, nothing is rewritten, and a load costs what its delivery costs. One small file commits a load, so
readers see all of it or nothing, documents and features together. Tables are read as the committed
loads without the retired keys; ``compact`` writes them anew as one load.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dirlens.plans.directory import Directory
from dirlens.plans.features import features
from dirlens.schema import KEY, REJECTED_SCHEMA, RESOURCE_SCHEMA, RUN_SCHEMA
from dirlens.session import work_folder
from dirlens.sources.ndjson import POSITION, Delivery, parse_lines, read_lines, size_in_bytes

# A list of this many keys takes some 20 MB, unless they are long.
BROADCAST_KEYS = 100_000
BROADCAST_KEY_BYTES = 16 << 20

CODEC = "zstd"

DOCUMENT_COLUMNS = ["fhir_id", "raw_json", "doc", "source_file", "ingested_at", "source_dataset"]


class RejectedLines(ValueError):
    """Lines of a delivery are no documents and the ingest was asked not to go on."""


class MissingFeatures(RuntimeError):
    """Documents are stored whose features aren't."""


@dataclass(frozen=True)
class Staged:
    """A delivery written as parsed rows, with what was counted on the way."""

    delivery: Delivery
    path: str
    size: int
    record_count: int
    error_count: int
    blank_count: int
    process_ms: int
    total_ms: int


def key_counts(staged: DataFrame) -> DataFrame:
    """How many lines each document has."""
    return staged.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies"))


def _last_positions(staged: DataFrame) -> DataFrame:
    """The position of the last line per key, with a partial maximum per task."""
    return staged.groupBy(*KEY).agg(F.max(F.struct(*POSITION)).alias("last"))


def _sized(keys: DataFrame, n: int, size: int = 0) -> DataFrame:
    """Keys for a join: broadcast when their counted number and bytes are small; otherwise both sides are shuffled, and only keys are held."""
    return F.broadcast(keys) if n <= BROADCAST_KEYS and size <= BROADCAST_KEY_BYTES else keys.hint("shuffle_hash")


def _load_name(load_id: str) -> str:
    """A load's name in paths; never a number, which a reader of paths would take it for."""
    return f"load-{load_id}"


def last_write_wins(staged: DataFrame, counts: DataFrame, n_repeated: int) -> DataFrame:
    """One row per key, the last line. ``n_repeated`` is the counted number of keys with several lines.

    Deliveries repeat few ids, if any: their last positions are broadcast and no document is
    shuffled, however many lines one id has. Beyond that, rows meet their last position in a join
    that includes the position, which spreads the copies of a key evenly.
    """
    if n_repeated == 0:
        return staged
    if n_repeated <= BROADCAST_KEYS:
        repeated = F.broadcast(counts.filter("copies > 1").select(*KEY))
        last = _last_positions(staged.select(*KEY, *POSITION).join(repeated, KEY, "left_semi"))
        return (
            staged.join(F.broadcast(last), KEY, "left")
            .filter(F.col("last").isNull() | (F.col("last") == F.struct(*POSITION)))
            .drop("last")
        )
    last = _last_positions(staged).select(*KEY, "last.*")
    return staged.join(last, [*KEY, *POSITION], "left_semi")


@dataclass(frozen=True)
class Commit:
    """A finished load: the number of documents per dataset, of keys retired in earlier loads, and the loads it stands in for."""

    load: str
    datasets: dict[str, int]
    retired: int
    retired_bytes: int
    replaces: list[str]


class Store:
    """Tables below ``root``. Every table can be read from the start, empty until it is loaded."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        # A repeated member keeps its last value; otherwise such a document would be rejected.
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")

    def _path(self, kind: str, resource: str) -> str:
        return f"{self.root}/{kind}/{resource}"

    def _place(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _delete(self, path: str) -> None:
        place = self._place(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def _files(self, path: str):
        place = self._place(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        place, files = self._files(path)
        return files.exists(place)

    # --- commits ---------------------------------------------------------------------------

    def commits(self, resource: str) -> list[Commit]:
        """The loads that make up a resource now."""
        place, files = self._files(self._path("commits", resource))
        if not files.exists(place):
            return []
        found = []
        for status in files.listStatus(place):
            if status.getPath().getName().endswith(".json"):
                with_bytes = files.open(status.getPath())
                found.append(Commit(**json.loads(bytes(with_bytes.readAllBytes()))))
                with_bytes.close()
        replaced = {load for c in found for load in c.replaces}
        return sorted((c for c in found if c.load not in replaced), key=lambda c: c.load)

    def _commit(self, resource: str, commit: Commit) -> None:
        """Makes a load visible, by one rename."""
        folder = self._path("commits", resource)
        place, files = self._files(f"{folder}/{commit.load}.json")
        draft = self._place(f"{folder}/_{commit.load}.draft")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps(vars(commit)).encode()))
        out.close()
        if not files.rename(draft, place):
            raise OSError(f"{place} can't be written")

    def _live(self, kind: str, resource: str, commits: Sequence[Commit]) -> DataFrame | None:
        """The rows of some loads, with their ``load``, without the keys that later loads took over; None without rows."""
        base = self._path(kind, resource)
        paths = [f"{base}/load={c.load}" for c in commits if c.datasets]
        if not paths:
            return None
        rows = self.spark.read.option("basePath", base).parquet(*paths)
        retiring = [c for c in commits if c.retired]
        if not retiring:
            return rows
        gone = self.spark.read.parquet(*(f"{self._path('retired', resource)}/by={c.load}" for c in retiring))
        n, size = sum(c.retired for c in retiring), sum(c.retired_bytes for c in retiring)
        return rows.join(_sized(gone, n, size), [*KEY, "load"], "left_anti").select(rows.columns)

    def _existing(self, path: str) -> DataFrame | None:
        place = self._place(path)
        found = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)
        return self.spark.read.parquet(path) if found else None

    def _table(self, path: str, schema: StructType) -> DataFrame:
        """A stored table; an empty one before anything was stored."""
        found = self._existing(path)
        return self.spark.createDataFrame([], schema) if found is None else found.select(schema.names)

    def documents(self, resource: str) -> DataFrame:
        found = self._live("documents", resource, self.commits(resource))
        return self.spark.createDataFrame([], RESOURCE_SCHEMA) if found is None else found.select(RESOURCE_SCHEMA.names)

    def _without_features(self, resource: str, commits: Sequence[Commit]) -> list[Commit]:
        base = self._path("features", resource)
        return [c for c in commits if c.datasets and not self._exists(f"{base}/load={c.load}/_SUCCESS")]

    def features(self, resource: str) -> DataFrame:
        """The feature table; projected from the documents where none was written.

        Features belong to the load whose documents they were made from. If only some loads have them, no report should be made.
        """
        commits = self.commits(resource)
        missing = self._without_features(resource, commits)
        if len(missing) == sum(bool(c.datasets) for c in commits):
            return features(self.documents(resource), resource)
        if missing:
            names = sorted({d for c in missing for d in c.datasets})
            raise MissingFeatures(f"{resource}: no features of loads of {', '.join(names)}; call write_features")
        return self._live("features", resource, commits).drop("load")

    def rejected(self, resource: str) -> DataFrame:
        return self._table(self._path("rejected", resource), REJECTED_SCHEMA)

    def runs(self) -> DataFrame:
        return self._table(f"{self.root}/runs", RUN_SCHEMA)

    def directory(self) -> Directory:
        """Reports over the stored feature tables."""
        return Directory(self.features, self.documents, self.runs)

    def _write(self, rows: DataFrame, kind: str, resource: str, load: str) -> None:
        """The rows of one load. What a load that broke off has left is replaced."""
        rows.write.mode("overwrite").option("compression", CODEC).partitionBy("source_dataset").parquet(
            f"{self._path(kind, resource)}/load={load}"
        )

    # --- ingest ----------------------------------------------------------------------------

    def _stage(self, delivery: Delivery, folder: str, place: int) -> Staged:
        """Decode and parse one delivery, the ``place``-th of a load, and write the rows with their positions."""
        start = time.monotonic()
        size = size_in_bytes(self.spark, delivery.path)
        process_start = time.monotonic()
        path = f"{folder}/{place:05d}-{delivery.dataset}"
        counted = Observation()
        parse_lines(read_lines(self.spark, delivery.path), delivery.dataset, F.lit(place)).observe(
            counted,
            F.count_if(F.col("problem").isNull()).alias("records"),
            F.count_if(F.col("problem") == "blank").alias("blanks"),
            F.count_if(F.col("problem") != "blank").alias("errors"),
        ).write.option("compression", CODEC).parquet(path)
        end = time.monotonic()
        found = counted.get
        return Staged(
            delivery,
            path,
            size,
            found["records"],
            found["errors"],
            found["blanks"],
            round((end - process_start) * 1000),
            round((end - start) * 1000),
        )

    def ingest_all(self, groups: Sequence[Sequence[Delivery]], on_reject: str = "quarantine") -> None:
        """Load groups of deliveries, one resource after the other; the first failure ends the run."""
        for deliveries in groups:
            self.ingest(deliveries, on_reject)

    def ingest(self, deliveries: Sequence[Delivery], on_reject: str = "quarantine") -> None:
        """Load deliveries of one resource: stage, validate, merge, log.

        Deliveries are staged concurrently and merged in one write, so a failure leaves the table
        as it was. Of the lines of one id the one of the later delivery in the list wins. ``on_reject='fail'`` stops before the merge when a line is no document;
        ``'quarantine'`` stores such lines. Blank lines are counted and skipped.
        """
        resource = {d.resource for d in deliveries}
        if len(resource) != 1:
            raise ValueError("deliveries must belong to one resource")
        (name,) = resource
        folder = work_folder(self.spark, f"stage-{name}")
        with ThreadPoolExecutor(max_workers=len(deliveries)) as pool:
            staged = list(pool.map(lambda d: self._stage(d[1], folder, d[0]), enumerate(deliveries)))
        failed = [s for s in staged if s.error_count]
        if failed and on_reject == "fail":
            raise RejectedLines(", ".join(f"{s.delivery.name}: {s.error_count} lines" for s in failed))
        self.load_staged(self.spark.read.parquet(*[s.path for s in staged]), staged, name, uuid.uuid4().hex)
        # The staged rows are in the table now; after a failure they stay for a look.
        self._delete(folder)

    def load_staged(self, rows: DataFrame, staged: Sequence[Staged], resource: str, load_id: str) -> None:
        """Quarantine, merge, write features and log; what batch and incremental loads share.

        Rejected lines and log rows are kept under the load's id: a load that is repeated replaces its own, and
        changes no documents if it was committed. If features were written before, the load's are written
        with its documents and become visible with them.
        """
        merge_start = time.monotonic()
        if any(s.error_count for s in staged):
            self._quarantine(rows, resource, load_id)
        stored = self.upsert(rows.filter("problem is null"), resource, load_id)
        self._log(staged, resource, stored, round((time.monotonic() - merge_start) * 1000), load_id)

    def _quarantine(self, rows: DataFrame, resource: str, load_id: str) -> None:
        rows.filter("problem is not null and problem <> 'blank'").select(
            "source_dataset",
            "source_file",
            "ingested_at",
            "problem",
            F.octet_length("raw_json").cast("long").alias("n_bytes"),
            "raw_json",
        ).write.mode("overwrite").parquet(f"{self._path('rejected', resource)}/load_id={load_id}")

    def upsert(self, rows: DataFrame, resource: str, load_id: str | None = None) -> dict[str, int]:
        """Replace or add documents by (dataset, id); returns the distinct keys per dataset.

        Of stored documents only the keys of the same datasets are read, to find those that this load takes over.
        """
        load = _load_name(load_id or uuid.uuid4().hex)
        commits = self.commits(resource)
        done = next((c for c in commits if c.load == load), None)
        if done:
            return done.datasets
        counts = key_counts(rows).persist()
        try:
            # One line per dataset.
            found = counts.groupBy("source_dataset").agg(
                F.count(F.lit(1)).alias("keys"), F.count_if(F.col("copies") > 1).alias("repeated"), F.sum(F.octet_length("fhir_id")).alias("size")
            ).collect()
            stored = {r["source_dataset"]: r["keys"] for r in found}
            retired = retired_bytes = 0
            if stored:
                survivors = last_write_wins(rows, counts, sum(r["repeated"] for r in found))
                self._write(survivors.withColumn("doc", F.parse_json("raw_json")).select(*DOCUMENT_COLUMNS), "documents", resource, load)
                earlier = [c for c in commits if stored.keys() & c.datasets.keys()]
                if earlier:
                    retired, retired_bytes = self._retire(counts, resource, load, earlier, stored, sum(r["size"] for r in found))
        finally:
            counts.unpersist()
        commit = Commit(load, stored, retired, retired_bytes, [])
        missing = self._without_features(resource, commits)
        if stored and len(missing) < sum(bool(c.datasets) for c in commits):
            self._write_features(resource, commit)
        self._commit(resource, commit)
        return stored

    def _retire(self, counts: DataFrame, resource: str, load: str, earlier: Sequence[Commit], stored: dict[str, int], size: int) -> tuple[int, int]:
        """Writes the keys that a load takes over, with the load that had them; their number and bytes."""
        path = f"{self._path('retired', resource)}/by={load}"
        # All commits: a key that was retired before isn't taken over again
        old = self._live("documents", resource, self.commits(resource)).filter(F.col("source_dataset").isin(*stored)).select(*KEY, "load")
        old.join(_sized(counts.select(*KEY), sum(stored.values()), size), KEY, "left_semi").write.mode("overwrite").parquet(path)
        n = self.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("fhir_id")).alias("size")).first()
        return n["n"], n["size"] or 0

    def compact(self, resource: str) -> None:
        """Writes all documents and features of a resource as one load, and deletes the loads that it stands in for.

        Until it is committed the old loads are read; what is left of them after a failure is not read any more.
        """
        commits = self.commits(resource)
        documents = self._live("documents", resource, commits)
        if documents is None or (len(commits) == 1 and not commits[0].retired):
            return
        load = _load_name(uuid.uuid4().hex)
        self._write(documents.select(*DOCUMENT_COLUMNS), "documents", resource, load)
        written = self.spark.read.parquet(f"{self._path('documents', resource)}/load={load}")
        datasets = {r["source_dataset"]: r["n"] for r in written.groupBy("source_dataset").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not self._without_features(resource, commits):
            self._write(self._live("features", resource, commits).drop("load"), "features", resource, load)
        self._commit(resource, Commit(load, datasets, 0, 0, [c.load for c in commits]))
        for c in commits:
            for kind, part in (("documents", "load"), ("features", "load"), ("retired", "by")):
                self._delete(f"{self._path(kind, resource)}/{part}={c.load}")
            self._delete(f"{self._path('commits', resource)}/{c.load}.json")

    def _log(self, staged: Sequence[Staged], resource: str, stored: dict[str, int], merge_ms: int, load_id: str) -> None:
        """One row per delivery. The merge time is part of each delivery's total."""
        records: dict[str, int] = {}
        for s in staged:
            records[s.delivery.dataset] = records.get(s.delivery.dataset, 0) + s.record_count
        now = datetime.now(timezone.utc)
        lines = []
        for s in staged:
            process_ms = s.process_ms + merge_ms
            dataset = s.delivery.dataset
            lines.append(
                (
                    now, s.delivery.name, dataset, resource, s.delivery.compression, s.size, None,
                    process_ms, s.total_ms + merge_ms, s.record_count, s.error_count, s.blank_count,
                    records[dataset] - stored.get(dataset, 0),
                    s.record_count / (process_ms / 1000) if process_ms else 0.0,
                )
            )
        self.spark.createDataFrame(lines, RUN_SCHEMA).write.mode("overwrite").parquet(
            f"{self.root}/runs/load_id={load_id}"
        )

    # --- features --------------------------------------------------------------------------

    def _write_features(self, resource: str, commit: Commit) -> None:
        base = self._path("documents", resource)
        documents = self.spark.read.option("basePath", base).parquet(f"{base}/load={commit.load}").select(RESOURCE_SCHEMA.names)
        self._write(features(documents, resource), "features", resource, commit.load)

    def write_features(self, resource: str, datasets: Sequence[str] | None = None) -> None:
        """Extract the features of all loads that have none, or of those with some of the datasets."""
        for commit in self._without_features(resource, self.commits(resource)):
            if datasets is None or commit.datasets.keys() & set(datasets):
                self._write_features(resource, commit)
