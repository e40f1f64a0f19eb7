"""Reports over the run log."""

from datetime import datetime

import pytest

from dirlens.operators.runs import latest_runs, run_compare, run_report, run_totals
from dirlens.schema import RUN_SCHEMA

A, B = "dataset-a", "dataset-b"


def run(day, ds, size, process_ms, records):
    return (
        datetime(2024, 1, day), f"f{day}", ds, "organization", "zst", size, None, process_ms, process_ms + 5, records,
        0, 0, 0, records / (process_ms / 1000),
    )


@pytest.fixture
def runs(spark):
    return spark.createDataFrame(
        [run(1, A, 10485760, 2000, 100), run(2, A, 20971520, 1450, 200), run(1, B, 2097152, 500, 10), run(2, B, 0, 500, 10)],
        RUN_SCHEMA,
    )


def test_report(runs, rows):
    first = rows(run_report(runs.filter("source_file = 'f2' and source_dataset = 'dataset-a'")))[0]
    assert first["compressed_size_mb"] == 20.0
    assert (first["download_sec"], first["process_sec"], first["total_sec"]) == (None, 1.5, 1.5)
    assert first["records_per_sec"] == 138.0


def test_every_pair_of_reruns_is_compared(runs):
    assert run_compare(runs, latest_only=False).count() == 4


def test_only_the_latest_runs_are_compared(runs, rows):
    assert latest_runs(runs).count() == 2
    (got,) = rows(run_compare(runs))
    assert (got["dataset_a_mb"], got["dataset_b_mb"], got["size_ratio_a_over_b"]) == (20.0, 0.0, None)


def test_totals(runs):
    assert [tuple(r) for r in run_totals(runs).collect()] == [(A, 300, 0, 3460), (B, 20, 0, 1010)]
