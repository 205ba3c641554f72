import pytest

from attune.plans import catalog
from tests.parity import connect, rows_of_spark, rows_of_sql


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, small, con, name):
    got = rows_of_spark(catalog.QUERIES[name](spark, small))
    want = rows_of_sql(con, catalog.ORACLES[name])
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, small, name):
    rows = catalog.QUERIES[name](spark, small).collect()
    assert rows and any(v is not None for r in rows for v in r)


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
