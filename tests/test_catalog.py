"""Every registered query against its SQL."""

import os

import pytest

from tessera.plans import catalog, details  # noqa: F401  (both register into catalog)

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, same, name):
    same(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def test_entry_point():
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
