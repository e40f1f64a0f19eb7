"""The tables a report reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dirlens.plans.features import features
from dirlens.schema import RESOURCES
from dirlens.session import work_folder
from dirlens.sources import derived

# Where the features of the test tables were written, by application, data set and resource.
_WRITTEN: dict[tuple[str, str, str], str] = {}


class Directory:
    """Feature tables by resource name, document tables, and the run log.

    The loaders decide where the tables come from: documents that are projected lazily, or
    feature tables written earlier. A report only sees columns.
    """

    def __init__(
        self,
        load_features: Callable[[str], DataFrame],
        load_documents: Callable[[str], DataFrame] | None = None,
        load_runs: Callable[[], DataFrame] | None = None,
    ) -> None:
        self._features = load_features
        self._documents = load_documents
        self._runs = load_runs

    def __getitem__(self, resource: str) -> DataFrame:
        if resource not in RESOURCES:
            raise KeyError(resource)
        return self._features(resource)

    def documents(self, resource: str) -> DataFrame:
        if self._documents is None:
            raise ValueError("this directory holds feature tables only")
        return self._documents(resource)

    @property
    def runs(self) -> DataFrame:
        if self._runs is None:
            raise ValueError("this directory has no run log")
        return self._runs()


def from_documents(load: Callable[[str], DataFrame], runs: Callable[[], DataFrame] | None = None) -> Directory:
    """Reports straight from documents; only the members a report needs are read."""
    return Directory(lambda resource: features(load(resource), resource), load, runs)


def _stored_features(spark: SparkSession, sf_dir: str, resource: str) -> DataFrame:
    """The feature table of whole documents, written once per session and data set."""
    key = (spark.sparkContext.applicationId, sf_dir, resource)
    if key not in _WRITTEN:
        path = f"{work_folder(spark, f'features-{resource}')}/table"
        rows = features(derived.documents(spark, sf_dir, resource), resource)
        rows.write.option("compression", "zstd").partitionBy("source_dataset").parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def from_test_tables(spark: SparkSession, sf_dir: str) -> Directory:
    """The directory derived from the star-schema test tables, with stored features."""
    return Directory(
        lambda resource: _stored_features(spark, sf_dir, resource),
        lambda resource: derived.documents(spark, sf_dir, resource),
        lambda: derived.run_log(spark, sf_dir),
    )
