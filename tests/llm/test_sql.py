"""The corpus queries that SQL can express, against it."""

import pytest

from marginspark.llm.oracles import ORACLES
from marginspark.llm.queries import QUERIES
from tests.conftest import SMALL
from workload.check import differences, duck


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    assert len(got)
    assert differences(got, duck(SMALL).sql(ORACLES[name]).df()) == ""


def test_each_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
