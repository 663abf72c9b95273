"""Every query that has SQL, against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TREES = entry.trees


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(x):
        return round(x, 6) if isinstance(x, float) and math.isfinite(x) else x

    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(TREES.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = TREES.QUERIES[name](spark, FOLDER)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(TREES.ORACLE_SQL[name])
    assert got == rows([d[0] for d in cursor.description], cursor.fetchall())


def test_known_sums(spark):
    found = entry.entry(spark).agg({"n_dups": "sum", "n_losses": "sum", "score": "sum", "gt_id": "count"}).first().asDict()
    assert found == {"sum(n_dups)": 2687, "sum(n_losses)": 21318, "sum(score)": 24005, "count(gt_id)": 1473}
