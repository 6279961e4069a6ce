"""Every registered query of the engine against its SQL."""

import pytest

from tessera.plans import registry
from tests.oracle import assert_same

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert_same(spark, registry.queries()[name], SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
