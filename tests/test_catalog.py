"""Every catalog query against its SQL at the smallest scale."""

import pytest

import __spark_entry__
from tests.conftest import SMALL, canonical, collected
from tracelake.plans import catalog, catalog_layers

SQL = catalog.ORACLE_SQL | catalog_layers.ORACLE_SQL


@pytest.mark.parametrize("name", sorted([*catalog.QUERIES, *catalog_layers.QUERIES]))
def test_query(spark, duck, name):
    got = collected(__spark_entry__.queries()[name](spark, SMALL))
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
