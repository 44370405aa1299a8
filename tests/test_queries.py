import pytest
from oracle import compare

from cutline.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    compare(spark, QUERIES[name], ORACLE_SQL[name], SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
