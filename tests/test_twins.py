"""Each query against its SQL twin."""

import compare
import pytest

from veilspark.plans.oracle import ORACLE_SQL
from veilspark.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_twin(spark, con, name):
    assert not compare.differences(spark, con, QUERIES[name], ORACLE_SQL[name], SF)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(ORACLE_SQL) <= set(e.oracle_sql())
