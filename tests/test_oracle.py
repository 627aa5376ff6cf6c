import pytest

from ranklake.plans import registry
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql_but_those_that_need_python():
    assert set(registry.QUERIES) - set(registry.SQL) == {"chunk_markdown", "hash_embedding_search"}
    assert set(registry.SQL) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, con, name):
    assert difference(registry.QUERIES[name](spark, SF), con, registry.SQL[name]) is None
