import pytest

from pixelloom.llm import queries
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.01"
QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    assert (why := compare(spark, con, name, QUERIES[name], SQL[name], SF)) is None, why
