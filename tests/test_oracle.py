"""Every query with SQL against DuckDB, and every other one read to its last value."""

import __spark_entry__ as entry
import pytest

from barloom.plans import catalogue
from compare import connection, differences

SF_DIR = "/root/testdata/sf0.01"
SQL = entry.oracle_sql()
#: Queries that the given tables have no rows for.
EMPTY = {"scenario_summary", "scenarios_15m"}


@pytest.fixture(scope="module")
def con():
    return connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n in catalogue.QUERIES))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    if name in SQL:
        assert differences(df, SQL[name], con) == []
    else:
        assert len(df.columns) == len(set(df.columns))
        assert df.collect() or name in EMPTY


def test_entry(spark):
    assert entry.entry(spark).collect()
