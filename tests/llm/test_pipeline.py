"""The pipeline's stages on their own inputs, and its queries that SQL can express."""

import pytest

import corpus_pipeline
from dirlens.llm import decontaminate, quality
from dirlens.llm.common import table, written
from dirlens.llm.queries import ORACLE, QUERIES
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), connect(SF), ORACLE[name]) is None


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(written(stage(spark, kept[-1], SF), "test-stage"))
    first, good, lines, single, clear, ids = kept
    assert all(df.columns == columns and df.dtypes == docs.dtypes for df in kept[:-1])
    model = quality.learn(docs, table(spark, SF, "labels"))
    passed = {r.doc_id for r in quality.score(first, model).collect() if r.score >= quality.THRESHOLD}
    assert {r.doc_id for r in good.collect()} == passed
    assert {r.doc_id for r in lines.collect()} == passed and lines.filter("n_chars <> length(text)").count() == 0
    before, after = ({r.doc_id: r.text.split("\n") for r in df.collect()} for df in (good, lines))
    assert all(set(after[d]) <= set(before[d]) | {""} for d in passed)
    alone = {r.doc_id for r in single.collect()}
    assert alone < passed
    hit = {r.doc_id for r in decontaminate.matches(single, table(spark, SF, "benchmark")).collect()}
    assert {r.doc_id for r in clear.collect()} == alone - hit
    assert {r.doc_id for r in ids.collect()} == alone - hit and ids.filter("n_tokens <> size(ids)").count() == 0


def test_empty_and_odd_documents(spark, odd, none):
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, none, SF).collect() == [], name
    out = corpus_pipeline.STAGES[3][1](spark, corpus_pipeline.STAGES[1][1](spark, odd, SF), SF)
    assert out.columns == odd.columns and out.count() == odd.count()
