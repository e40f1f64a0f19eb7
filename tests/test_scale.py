"""Plans, skew and partitioning."""

import re

import pytest
from pyspark.sql import functions as F

from dirlens.operators import skew
from dirlens.operators.integrity import resolve_reference_lists
from dirlens.operators.skew import exists_flag
from dirlens.plans.directory import Directory, from_documents, from_test_tables
from dirlens.plans.features import features
from dirlens.plans.reports import REPORTS
from dirlens.schema import RESOURCES
from dirlens.sources import derived as sources
from dirlens.sources.derived import documents
from dirlens.sources.partitions import ROWS, bounded

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("BroadcastNestedLoopJoin", "CartesianProduct", "PythonUDF", "BatchEvalPython", "ArrowEvalPython")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def derived(spark):
    return from_test_tables(spark, SF)


@pytest.fixture(scope="module")
def stored(spark, derived, tmp_path_factory):
    """The same directory with feature tables in Parquet."""
    root = str(tmp_path_factory.mktemp("features"))
    for resource in ("practitioners", "practitioner_roles", "organizations", "locations"):
        derived[resource].write.partitionBy("source_dataset").parquet(f"{root}/{resource}")
    return Directory(lambda r: spark.read.parquet(f"{root}/{r}"))


@pytest.mark.parametrize("name", REPORTS)
def test_no_nested_loops_and_no_python(derived, name):
    text = plan(REPORTS[name](derived))
    assert not [word for word in FORBIDDEN if word in text]


@pytest.mark.parametrize(
    "name", ["practitioner_completeness", "role_extension_census", "directory_completeness", "role_specialty_coverage"]
)
def test_a_document_is_parsed_once(spark, name):
    whole = from_documents(lambda resource: documents(spark, SF, resource))
    text = plan(REPORTS[name](whole))
    scans = len(re.findall(r"FileScan parquet", text))
    assert text.count("parseJson") <= scans


def test_reports_read_the_features_of_whole_documents(spark, derived):
    for resource in RESOURCES:
        whole = features(documents(spark, SF, resource), resource)
        read = derived[resource].select(whole.columns)
        assert sorted(map(str, read.collect())) == sorted(map(str, whole.collect()))


def test_only_the_columns_of_the_members_in_use_are_scanned(derived):
    columns = re.search(r"FileScan parquet \[([^\]]*)\]", plan(REPORTS["role_contact_invariant"](derived))).group(1)
    assert {c.split("#")[0] for c in columns.split(",")} <= set(features(derived.documents("practitioner_roles"), "practitioner_roles").columns)
    assert len(columns.split(",")) <= 4


def test_completeness_is_one_scan_of_its_columns(stored):
    text = plan(REPORTS["practitioner_completeness_brief"](stored))
    assert text.count("FileScan parquet") == 1
    columns = re.search(r"FileScan parquet \[([^\]]*)\]", text).group(1)
    assert {c.split("#")[0] for c in columns.split(",")} == {
        "has_name", "has_gender", "has_qualification", "has_communication", "has_active", "source_dataset",
    }


@pytest.mark.parametrize(
    "name",
    ["role_practitioner_refs", "organization_parent_refs", "directory_completeness", "practitioner_role_coverage",
     "practitioner_npi_overlap", "organization_id_overlap"],
)
def test_co_aggregation_needs_no_join(stored, name):
    assert "Join" not in plan(REPORTS[name](stored))


def final_plan(df):
    """The plan as it ran, without what was reused."""
    df.collect()
    return plan(df).split("+- == Initial Plan ==")[0].split("== Initial Plan ==")[0]


@pytest.fixture
def without_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def nodes(df):
    """(name, input columns) of every operator of a plan."""
    todo, found = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.initialPlan()
        children = [node.children().apply(i) for i in range(node.children().size())]
        columns = {c.output().apply(i).name() for c in children for i in range(c.output().size())}
        found.append((node.nodeName(), columns))
        todo += children
    return found


PAYLOAD = {"name", "telecom_json", "address_json", "type_json", "endpoint_json", "values"}


@pytest.mark.parametrize("name", ["organization_consolidation", "organization_reconciliation"])
def test_merging_sorts_no_payload(stored, without_broadcast, name):
    """Winners are found by names and times; values are fetched for them by a hash join and never sorted."""
    found = nodes(REPORTS[name](stored))
    assert {"ShuffledHashJoin", "ObjectHashAggregate"} <= {n for n, _ in found} and "SortMergeJoin" not in {n for n, _ in found}
    assert [n for n, columns in found if n.startswith("Sort") and columns & PAYLOAD] == []
    # values are moved twice: to their winners' names, and to the identity
    assert sum(bool(columns & (PAYLOAD | {"found"})) for n, columns in found if n == "Exchange") <= 2


@pytest.mark.parametrize("name", ["organization_hierarchy_depth", "organization_hierarchy_depth_resolved"])
def test_hierarchy_doubles_its_steps(stored, without_broadcast, name):
    """Three joins double the jumps, two move the counts on; a semi-join picks the parents."""
    joins = re.findall(r"(?:SortMergeJoin|ShuffledHashJoin|BroadcastHashJoin).*LeftOuter", final_plan(REPORTS[name](stored)))
    assert len(joins) == 5


def test_top_k_per_dataset_is_cut_before_the_exchange(stored):
    assert "WindowGroupLimit" in plan(REPORTS["role_specialty_codes_per_dataset"](stored))
    assert "WindowGroupLimit" in plan(REPORTS["role_sample_per_dataset"](stored))


def test_stored_features_give_the_same_reports(derived, stored):
    for name in ("directory_completeness", "role_location_refs", "organization_consolidation", "practitioner_sample"):
        expected = sorted(map(str, REPORTS[name](derived).collect()))
        assert sorted(map(str, REPORTS[name](stored).collect())) == expected


def test_partitioning_does_not_change_results(spark, stored):
    one = Directory(lambda r: stored[r].coalesce(1))
    many = Directory(lambda r: stored[r].repartition(13))
    for name in ("roles_per_practitioner", "organization_hierarchy_depth", "identifier_fragmentation",
                 "role_location_refs", "role_organization_refs"):
        assert REPORTS[name](one).collect() == REPORTS[name](many).collect()


def hot_links(spark, n=60000):
    """A third of the links has one target, a sixth has none."""
    target = (
        F.when(F.col("id") % 3 == 0, F.lit("hot"))
        .when(F.col("id") % 6 == 1, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("t"), F.col("id")))
    )
    return spark.range(n).select(F.col("id").cast("string").alias("row"), target.alias("target"))


@pytest.mark.parametrize("look", [0.0, 0.01, 1.0])
def test_exists_flag_is_exact_with_hot_keys(spark, look):
    links = hot_links(spark)
    targets = spark.range(0, 60000, 2).select(F.concat(F.lit("t"), F.col("id")).alias("target"))
    targets = targets.unionByName(spark.createDataFrame([("hot",), ("hot",), (None,)], "target string"))
    flagged = exists_flag(links, targets, ["target"], "row", "found", hot_keys=4, salts=16, look=look)
    assert flagged.columns == ["target", "row", "found"]
    got = flagged.agg(
        F.count("*").alias("n"), F.count_if("found").alias("found"), F.count_if(F.col("found") & (F.col("target") == "hot")).alias("hot")
    ).first()
    expected_others = sum(1 for i in range(60000) if i % 3 and i % 6 != 1 and i % 2 == 0)
    assert tuple(got) == (60000, 20000 + expected_others, 20000)


def test_hot_rows_spread_over_partitions(spark):
    """With broadcast joins off, no shuffle partition of the salted join holds the hot group."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        targets = spark.createDataFrame([("hot",), ("t2",)], "target string")
        flagged = exists_flag(hot_links(spark), targets, ["target"], "row", "found")
        sizes = flagged.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes[1] == 60000
    # Eight partitions; without salting one of them would hold a third of the rows and more.
    assert sizes[0] < 60000 / 4


def test_reference_lists_of_skewed_targets(spark):
    links = hot_links(spark, 3000).select(
        F.lit("dataset-a").alias("source_dataset"), F.col("row").alias("fhir_id"), F.lit(True).alias("has"),
        F.array(F.concat(F.lit("Location/"), F.col("target"))).alias("refs"),
    )
    locations = spark.createDataFrame([("dataset-a", "hot")], "source_dataset string, fhir_id string")
    got = resolve_reference_lists(links, "has", "refs", locations).first()
    assert (got.total, got.resolved, got.n_references, got.resolved_references) == (3000, 1000, 3000, 1000)


def per_task(df):
    """Rows of every partition that has some."""
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_rows_are_dealt_out_evenly_whatever_their_keys(spark, tmp_path):
    """One file split; half of the rows are equal and a quarter has no key."""
    key = F.when(F.col("id") % 2 == 0, F.lit(0)).when(F.col("id") % 4 == 1, F.lit(None)).otherwise(F.col("id"))
    spark.range(0, 20_000, 1, 1).select(key.cast("long").alias("k")).write.parquet(f"{tmp_path}/t")
    scan = spark.read.parquet(f"{tmp_path}/t")
    dealt = bounded(scan, 1000)
    assert dealt.columns == ["k"] and dealt.rdd.getNumPartitions() == 20
    sizes = per_task(dealt)
    assert max(sizes) < 1500 and sum(sizes) == 20_000
    assert dealt.exceptAll(scan).isEmpty() and scan.exceptAll(dealt).isEmpty()


def test_larger_tables_have_more_tasks_not_larger_ones(spark, tmp_path):
    """Nine times ROWS rows of a few bytes, read by one task, on eight cores."""
    spark.range(0, 9 * ROWS, 1, 1).withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    assert max(per_task(sources._rows(spark, str(tmp_path), "orders"))) < 1.1 * ROWS


def test_orders_are_folded_in_tasks_of_a_fixed_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sources, "LINES", 500)
    lines = spark.range(0, 20_000, 1, 1).selectExpr("id div 4 as l_orderkey", "id % 9 as l_suppkey", "if(id % 3 = 0, 'A', 'N') as l_returnflag")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    made = sources.raw_documents(spark, str(tmp_path), "organization_affiliations").filter("source_dataset = 'dataset-a'")
    sizes = per_task(made)
    assert sum(sizes) == 5000 and len(sizes) == 40 and max(sizes) < 250


def test_link_tasks_keep_their_size(spark, without_broadcast, monkeypatch):
    monkeypatch.setattr(skew, "ROWS", 2000)
    targets = spark.range(0, 60000, 2).select(F.concat(F.lit("t"), F.col("id")).alias("target"))
    flagged = exists_flag(hot_links(spark), targets, ["target"], "row", "found")
    sizes = per_task(flagged)
    assert sum(sizes) == 60000 and len(sizes) == 30 and max(sizes) < 6000
