"""Every query of the engine against its SQL, or for rows alone where SQL can't express it."""

import pytest

from galeframe.plans import registry
from tests.compare import difference

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, name):
    assert difference(QUERIES[name](spark, sf), SQL[name], sf) == ""


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
