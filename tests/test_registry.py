"""Every registered query of the library itself against its DuckDB counterpart."""

import pytest

from lumenstack.plans import registry

from .conftest import MIDDLE, canonical


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, MIDDLE)
    rows = [tuple(r) for r in df.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert canonical(rows, df.columns) == canonical(cursor.fetchall(), names)
