import pytest

from pixelloom.plans import audits, catalogue, details, findings
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries() | details.queries() | audits.queries() | findings.queries(), catalogue.oracle_sql() | details.oracle_sql() | audits.oracle_sql() | findings.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    assert (why := compare(spark, con, name, QUERIES[name], SQL[name], SF)) is None, why


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
