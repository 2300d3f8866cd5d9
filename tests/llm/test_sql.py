"""Every corpus query that has SQL, against that SQL at the smallest scale."""

import pytest

from tests.conftest import SMALL, canonical, collected
from tracelake.llm import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got, want = collected(registry.queries()[name](spark, SMALL)), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
