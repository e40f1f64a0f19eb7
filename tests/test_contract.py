"""Every registered query against its SQL, on the smallest data."""

import pytest

import __spark_entry__ as contract
from dirlens.plans.loads import LOADS
from dirlens.plans.reports import REPORTS
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.001"
QUERIES = contract.queries()
SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_report_and_load_has_its_sql():
    assert set(REPORTS) | set(LOADS) <= set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", [*REPORTS, *LOADS])
def test_query_equals_sql(spark, duck, name):
    assert differences(QUERIES[name](spark, SF), duck, SQL[name]) is None


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[:2] == ["source_dataset", "total_practitioners"]
    assert df.count() == 2
