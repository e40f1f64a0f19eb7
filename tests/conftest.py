from __future__ import annotations

import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import functions as F  # noqa: E402

from dirlens.plans.directory import from_documents  # noqa: E402
from dirlens.plans.features import features  # noqa: E402
from dirlens.schema import RESOURCES  # noqa: E402
from dirlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, app="dirlens-tests")


@pytest.fixture
def documents(spark):
    """Documents out of (dataset, JSON text or dict) pairs."""

    def build(*rows):
        texts = [(ds, d if isinstance(d, str) else json.dumps(d)) for ds, d in rows]
        df = spark.createDataFrame(texts, "source_dataset string, raw_json string")
        df = df.withColumn("doc", F.parse_json("raw_json"))
        return df.withColumn("fhir_id", F.try_variant_get("doc", "$.id", "string"))

    return build


@pytest.fixture
def table(documents):
    """A feature table of one resource out of (dataset, document) pairs."""
    return lambda resource, *rows: features(documents(*rows), resource)


@pytest.fixture
def directory(documents):
    """A directory with the given documents per resource; the others are empty."""

    def build(**tables):
        def load(resource):
            rows = tables.get(resource, [])
            made = documents(*(rows or [("dataset-a", {"id": "x"})]))
            return made if rows else made.limit(0)

        assert set(tables) <= set(RESOURCES)
        return from_documents(load)

    return build


@pytest.fixture
def rows():
    """Rows of a DataFrame as dictionaries."""
    return lambda df: [r.asDict() for r in df.collect()]
