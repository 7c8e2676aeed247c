import pytest

from quirewise.plans.catalog import ORACLE_SQL, QUERIES
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir)


def test_every_query_is_checked():
    assert {*QUERIES} - {*ORACLE_SQL} == set()
