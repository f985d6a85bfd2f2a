"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import database, mismatch

from __spark_entry__ import entry, oracle_sql, queries
from twinline.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    rows = QUERIES[name](spark, SF)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert name == "map_batches" or "Python" not in plan and "InPandas" not in plan
    assert mismatch(rows.toPandas(), con.execute(ORACLES[name]).df()) is None


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.items() <= queries().items() and ORACLES.items() <= oracle_sql().items()
