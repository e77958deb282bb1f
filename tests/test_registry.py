"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as driver
import oracle

SF = "/root/testdata/sf0.001"
RUNS, SQL = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert oracle.compare(spark, con, RUNS[name], SQL[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(RUNS) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert RUNS[name](spark, SF).count() > 0


def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert {r.type for r in rows} == {"SEQUENCE_GAP", "ILLEGAL_TRANSITION"}
