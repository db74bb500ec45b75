import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small_dir):
    return connect(small_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, small_dir, name):
    assert compare(entry.queries()[name](spark, small_dir), con, ORACLE[name]) is None


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows[0].asDict().keys() == {"age_group", "n", "deaths", "mortality_rate"}
