"""Every registered query against its SQL, and the shape of its plan."""

import pytest

import __spark_entry__ as driver
import oracle
from mailpolicy import catalog

SF = "/root/testdata/sf0.01"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    query = QUERIES[name](spark, SF)
    plan = query._jdf.queryExecution().executedPlan().toString()
    for operator in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "ExistingRDD"):
        assert operator not in plan
    assert oracle.compare(con, query, SQL[name]) > 0


def test_entry(spark):
    """Two snapshots, four zones, 13 metrics."""
    assert driver.entry(spark).count() == 2 * 4 * 13
