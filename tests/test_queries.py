import pytest

from evencut.plans import oracle
from evencut.plans.queries import QUERIES
from tests.compare import same

SQL = oracle.sqls()


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    same(spark, name, QUERIES[name], SQL[name])
