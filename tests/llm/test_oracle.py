"""The queries that SQL can express, against DuckDB."""

import pytest

from lumenstack.llm.queries import oracle_sql, queries
from tests.conftest import MIDDLE, canonical


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, duck, name):
    df = queries()[name](spark, MIDDLE)
    cursor = duck.execute(oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cursor.fetchall(), names)
