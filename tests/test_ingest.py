"""Loading text deliveries."""

import gzip
import hashlib
from pathlib import Path

import pytest
import zstandard
from pyspark.sql import functions as F

from dirlens.sources.ndjson import Delivery, parse_lines, read_lines
from dirlens.sources import store as stores
from dirlens.sources.store import MissingFeatures, RejectedLines, Store, key_counts, last_write_wins
from dirlens.streaming.incremental import ingest_new_files

A, B = "dataset-a", "dataset-b"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def write(path, *lines):
    path.write_text("".join(f"{line}\n" for line in lines))
    return str(path)


def contents(store, resource="endpoints"):
    docs = store.documents(resource).select("source_dataset", "fhir_id", F.try_variant_get("doc", "$.v", "string"))
    return sorted(tuple(r) for r in docs.collect())


def doc(ident, value):
    return f'{{"id":"{ident}","v":"{value}"}}'


def test_bad_lines_are_counted_and_kept_apart(store, tmp_path):
    path = write(tmp_path / "a.ndjson", doc(1, "x"), "", "{bad", "null", '{"resourceType":"X"}', '{"id":5}', '{"id":""}')
    store.ingest([Delivery(path, A, "endpoints")])
    assert contents(store) == [(A, "1", "x")]
    run = store.runs().first()
    assert (run.record_count, run.error_count, run.blank_count, run.duplicate_count) == (1, 5, 1, 0)
    assert (run.source_file, run.source_dataset, run.resource_type, run.compression) == ("a.ndjson", A, "endpoints", "none")
    assert run.compressed_size_bytes == (tmp_path / "a.ndjson").stat().st_size
    assert run.total_ms >= run.process_ms > 0 and run.records_per_sec > 0
    problems = {(r.problem, r["count"]) for r in store.rejected("endpoints").groupBy("problem").count().collect()}
    assert problems == {("not a document", 1), ("no id", 4)}


def test_fail_fast_leaves_the_table_alone(store, tmp_path):
    store.ingest([Delivery(write(tmp_path / "a.ndjson", doc(1, "x")), A, "endpoints")])
    bad = write(tmp_path / "b.ndjson", doc(1, "y"), "{bad")
    with pytest.raises(RejectedLines):
        store.ingest([Delivery(bad, A, "endpoints")], on_reject="fail")
    assert contents(store) == [(A, "1", "x")]
    assert store.runs().count() == 1


def test_the_last_line_of_an_id_wins_per_dataset(store, tmp_path):
    a = write(tmp_path / "a.ndjson", doc(1, "x"), doc(2, "k"), doc(1, "y"))
    b = write(tmp_path / "b.ndjson", doc(1, "z"))
    store.ingest([Delivery(a, A, "endpoints"), Delivery(b, B, "endpoints")])
    assert contents(store) == [(A, "1", "y"), (A, "2", "k"), (B, "1", "z")]
    counts = {r.source_dataset: (r.record_count, r.duplicate_count) for r in store.runs().collect()}
    assert counts == {A: (3, 1), B: (1, 0)}


def test_loading_again_replaces_adds_and_keeps(store, tmp_path):
    both = [Delivery(write(tmp_path / "a.ndjson", doc(1, "x"), doc(2, "k")), A, "endpoints"),
            Delivery(write(tmp_path / "b.ndjson", doc(1, "z")), B, "endpoints")]
    store.ingest(both)
    first = contents(store)
    store.ingest(both)
    assert contents(store) == first
    store.ingest([Delivery(write(tmp_path / "c.ndjson", doc(1, "new"), doc(3, "add")), A, "endpoints")])
    assert contents(store) == [(A, "1", "new"), (A, "2", "k"), (A, "3", "add"), (B, "1", "z")]
    assert store.runs().count() == 5


def test_compressed_text(store, tmp_path):
    (tmp_path / "a.ndjson.zst").write_bytes(zstandard.ZstdCompressor().compress(doc(1, "zst").encode()))
    (tmp_path / "b.ndjson.gz").write_bytes(gzip.compress(doc(2, "gz").encode()))
    store.ingest([Delivery(str(tmp_path / "a.ndjson.zst"), A, "endpoints"),
                  Delivery(str(tmp_path / "b.ndjson.gz"), B, "endpoints")])
    assert contents(store) == [(A, "1", "zst"), (B, "2", "gz")]
    assert {r.compression for r in store.runs().collect()} == {"zst", "gz"}


def test_resources_are_not_mixed(store, tmp_path):
    path = write(tmp_path / "a.ndjson", doc(1, "x"))
    with pytest.raises(ValueError):
        store.ingest([Delivery(path, A, "endpoints"), Delivery(path, A, "locations")])


@pytest.mark.parametrize("limit", [0, 100_000])
def test_last_line_over_many_splits_of_a_hot_id(spark, tmp_path, monkeypatch, limit):
    """A third of all lines belongs to one document; the file is read in many splits."""
    monkeypatch.setattr(stores, "BROADCAST_KEYS", limit)
    lines = [doc("hot" if i % 3 == 0 else i, i) for i in range(30000)]
    path = write(tmp_path / "a.ndjson", *lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        read = read_lines(spark, path)
        assert read.rdd.getNumPartitions() > 8
        staged = str(tmp_path / "staged")
        parse_lines(read, A, F.lit(0)).write.parquet(staged)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    rows = spark.read.parquet(staged)
    kept = last_write_wins(rows, key_counts(rows), 1)
    assert kept.count() == 20001
    (hot,) = kept.filter("fhir_id = 'hot'").select("raw_json").collect()
    assert hot.raw_json == doc("hot", 29997)


def files_of(store, *kinds):
    """Size and time of every file of some tables."""
    root = Path(store.root)
    return {str(f): (f.stat().st_size, f.stat().st_mtime_ns) for kind in kinds for f in (root / kind).rglob("*.parquet")}


TABLES = ("documents", "features", "retired")


@pytest.mark.parametrize("limit", [0, 100_000])
@pytest.mark.parametrize("batch", [range(3), range(8), range(10), range(20, 22)])
def test_loads_take_keys_over(store, tmp_path, monkeypatch, batch, limit):
    """Whatever part of the keys comes again, and again, of one dataset."""
    monkeypatch.setattr(stores, "BROADCAST_KEYS", limit)
    store.ingest([Delivery(write(tmp_path / f"{d}.ndjson", *(doc(i, "old") for i in range(10))), d, "endpoints") for d in (A, B)])
    for value in ("new", "newer"):
        store.ingest([Delivery(write(tmp_path / f"{value}.ndjson", *(doc(i, value) for i in batch)), A, "endpoints")])
    expected = {(A, str(i)): "old" for i in range(10)} | {(B, str(i)): "old" for i in range(10)} | {(A, str(i)): "newer" for i in batch}
    assert contents(store) == sorted((*k, v) for k, v in expected.items())
    assert sum(c.retired for c in store.commits("endpoints")) == 2 * len(batch) - (0 if batch[0] < 10 else len(batch))
    store.compact("endpoints")
    assert contents(store) == sorted((*k, v) for k, v in expected.items()) and len(store.commits("endpoints")) == 1


def test_a_small_load_writes_little_and_leaves_files_alone(store, tmp_path):
    lines = [doc(i, hashlib.sha256(str(i).encode()).hexdigest() * 8) for i in range(4000)]
    store.ingest([Delivery(write(tmp_path / "a.ndjson", *lines), A, "endpoints"), Delivery(write(tmp_path / "b.ndjson", *lines), B, "endpoints")])
    store.write_features("endpoints")
    before = files_of(store, *TABLES)
    store.ingest([Delivery(write(tmp_path / "c.ndjson", doc(7, "new")), A, "endpoints")])
    after = files_of(store, *TABLES)
    assert before.items() <= after.items()
    old, new = sum(n for n, _ in before.values()), sum(after[f][0] for f in after.keys() - before.keys())
    assert new < 40_000 < old / 10
    assert store.features("endpoints").count() == store.documents("endpoints").count() == 8000
    assert [r[2] for r in contents(store) if r[:2] == (A, "7")] == ["new"]


def test_a_load_that_breaks_off_is_not_seen_and_can_be_repeated(store, tmp_path, monkeypatch):
    store.ingest([Delivery(write(tmp_path / "a.ndjson", doc(1, "x"), doc(2, "k")), A, "endpoints")])
    store.write_features("endpoints")
    before = contents(store), sorted(map(str, store.features("endpoints").collect()))
    staged = str(tmp_path / "staged")
    parse_lines(read_lines(store.spark, write(tmp_path / "b.ndjson", doc(1, "y"))), A, F.lit(0)).write.parquet(staged)
    rows = store.spark.read.parquet(staged)

    def broken(*_):
        raise OSError("lost")

    for step in ("_write_features", "_commit"):
        with monkeypatch.context() as patch:
            patch.setattr(store, step, broken)
            with pytest.raises(OSError):
                store.upsert(rows, "endpoints", "again")
        assert (contents(store), sorted(map(str, store.features("endpoints").collect()))) == before
    for _ in range(2):  # a load that was committed changes nothing when it is repeated
        assert store.upsert(rows, "endpoints", "again") == {A: 1}
        assert contents(store) == [(A, "1", "y"), (A, "2", "k")]
        assert store.features("endpoints").count() == 2


def test_features_follow_the_loads_they_were_made_from(store, tmp_path):
    store.ingest([Delivery(write(tmp_path / "a.ndjson", doc(1, "x")), A, "endpoints")])
    store.write_features("endpoints")
    (commit,) = store.commits("endpoints")
    store.ingest([Delivery(write(tmp_path / "b.ndjson", doc(2, "y")), B, "endpoints")])
    late = next(c for c in store.commits("endpoints") if c.load != commit.load)
    store._delete(f"{store.root}/features/endpoints/load={late.load}")
    with pytest.raises(MissingFeatures):
        store.features("endpoints")
    store.write_features("endpoints", [B])
    assert store.features("endpoints").count() == 2


def test_compaction_keeps_features_and_survives_a_failure(store, tmp_path, monkeypatch):
    for i in range(3):
        store.ingest([Delivery(write(tmp_path / f"{i}.ndjson", doc(1, i), doc(10 + i, "k")), A, "endpoints")])
        store.write_features("endpoints")
    wanted = contents(store), sorted(map(str, store.features("endpoints").collect()))
    with monkeypatch.context() as patch:
        patch.setattr(store, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.compact("endpoints")
    assert (contents(store), sorted(map(str, store.features("endpoints").collect()))) == wanted
    store.compact("endpoints")
    assert (contents(store), sorted(map(str, store.features("endpoints").collect()))) == wanted
    (commit,) = store.commits("endpoints")
    assert commit.datasets == {A: 4} and commit.retired == 0
    store.ingest([Delivery(write(tmp_path / "z.ndjson", doc(1, "z")), A, "endpoints")])
    assert [r for r in contents(store) if r[1] == "1"] == [(A, "1", "z")] and store.features("endpoints").count() == 4


def test_features_are_written_per_dataset_and_serve_reports(store, tmp_path):
    from dirlens.plans.reports import REPORTS

    write(tmp_path / "a.ndjson", '{"id":"1","status":"on"}', '{"id":"2"}')
    write(tmp_path / "b.ndjson", '{"id":"1"}')
    store.ingest([Delivery(str(tmp_path / "a.ndjson"), A, "endpoints"),
                  Delivery(str(tmp_path / "b.ndjson"), B, "endpoints")])
    store.write_features("endpoints")
    status = lambda: [tuple(r) for r in REPORTS["endpoint_status"](store.directory()).collect()]
    assert status() == [(A, "on", 1), (A, None, 1), (B, None, 1)]
    store.ingest([Delivery(write(tmp_path / "c.ndjson", '{"id":"1","status":"off"}'), B, "endpoints")])
    store.write_features("endpoints", [B])
    assert status() == [(A, "on", 1), (A, None, 1), (B, "off", 1)]


def test_tables_are_empty_before_the_first_load(store):
    from dirlens.plans.reports import REPORTS

    assert store.documents("locations").count() == store.runs().count() == store.rejected("locations").count() == 0
    assert REPORTS["location_completeness"](store.directory()).collect() == []
    assert REPORTS["record_counts"](store.directory()).collect() == []


def test_new_files_are_picked_up_once(store, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    take = lambda: ingest_new_files(store, str(folder), A, "endpoints", str(tmp_path / "checkpoint"))
    write(folder / "1.ndjson", doc(1, "x"), doc(2, "k"), "{bad")
    take()
    write(folder / "2.ndjson", doc(1, "y"))
    take()
    take()
    assert contents(store) == [(A, "1", "y"), (A, "2", "k")]


def test_oversized_lines_do_not_stop_the_load(spark):
    # One string beyond the parser's limit for a single value.
    lines = spark.range(1).select(
        F.concat(F.lit('{"id":"1","t":"'), F.repeat(F.lit("x"), 20_000_001), F.lit('"}')).alias("value"),
        F.lit("f").alias("source_file"), F.lit("p").alias("source_path"), F.lit(0).alias("block_start"),
        F.lit(0).alias("line_id"),
    )
    parsed = parse_lines(lines, A, F.lit(0)).select("problem", F.octet_length("raw_json").alias("n")).first()
    assert (parsed.problem, parsed.n > 20_000_000) == ("not a document", True)


def test_a_delivery_without_accepted_lines_keeps_features(store, tmp_path):
    store.ingest([Delivery(write(tmp_path / f"{d}.ndjson", doc(1, "x")), d, "endpoints") for d in (A, B)])
    store.write_features("endpoints")
    before = sorted(map(str, store.features("endpoints").collect()))
    store.ingest([Delivery(write(tmp_path / "bad.ndjson", "{bad", ""), A, "endpoints")])
    assert sorted(map(str, store.features("endpoints").collect())) == before and len(before) == 2
    store.ingest([Delivery(write(tmp_path / "c.ndjson", doc(2, "y")), A, "endpoints"), Delivery(write(tmp_path / "d.ndjson", ""), B, "endpoints")])
    assert store.features("endpoints").count() == 3
