"""Every registered query of the analytics part against its SQL twin at the smallest scale."""

import pytest
from oracle import connect, rows

from regimeforge.plans import registry

SF = "/root/testdata/sf0.001"
ORACLE = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, con, name):
    got = registry.queries()[name](spark, SF).toPandas()
    expected = con.execute(ORACLE[name]).fetchdf()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)
