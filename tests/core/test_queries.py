"""Every registered query of the library's own operators runs; those with SQL equal DuckDB."""

import pytest

import __spark_entry__ as entry
from gleanspark.plans import field_queries  # noqa: F401
from gleanspark.plans.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    if name in ORACLE_SQL:
        compare(spark, duck, QUERIES[name], ORACLE_SQL[name], SF)
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 12
    assert set(entry.oracle_sql()) <= set(entry.queries())
