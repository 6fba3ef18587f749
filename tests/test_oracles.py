import pytest

from tests import oracle
from thermal_lake import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_its_sql(spark, connection, name):
    oracle.check(catalog.QUERIES[name](spark, FOLDER), connection, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    assert df.columns
    df.collect()
