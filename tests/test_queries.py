"""Every registered query against its SQL, or for rows and a stable schema without."""

import pytest

import __spark_entry__ as entry
from compare import difference, duck

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    result = QUERIES[name](spark, SF_DIR).toArrow()
    assert difference(result, con.sql(ORACLES[name]).to_arrow_table()) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    result = QUERIES[name](spark, SF_DIR)
    assert result.limit(1).count() == 1
    assert all(f.name for f in result.schema)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
