"""Every corpus operator that has SQL, against DuckDB on the smallest tables."""

import pytest

from test_queries import FOLDER, duck, rows  # noqa: F401
from thicket.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, duck, name):  # noqa: F811
    df = queries.QUERIES[name](spark, FOLDER)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(queries.ORACLE_SQL[name])
    assert got == rows([d[0] for d in cursor.description], cursor.fetchall())
