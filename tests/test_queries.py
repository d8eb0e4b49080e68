"""Every query with a SQL twin, on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from tests.conftest import SMALL
from workload.check import differences, duck

ORACLES = entry_points.oracle_sql()
QUERIES = entry_points.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    assert len(got)
    assert differences(got, con.sql(ORACLES[name]).df()) == ""


def test_entry_has_rows_and_a_stable_schema(spark):
    out = entry_points.entry(spark)
    assert out.columns == ["level", "id", "coef"]
    assert out.count() > 0
