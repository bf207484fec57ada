"""Every registered query against its DuckDB SQL on the smallest tables."""

import duckdb
import pytest
from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def order(row):
    """Exact values first, so that a last digit does not change the order."""
    return repr([x for x in row if not isinstance(x, float)]), repr([x for x in row if isinstance(x, float)])


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, (int, float)) and abs(a - b) <= 2e-6 * max(1, abs(a))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=order)
    if name not in catalogue.SQL:
        assert rows
        return
    want = duck.sql(catalogue.SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    oracle = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=order)
    assert len(rows) == len(oracle) and all(same(x, y) for r, o in zip(rows, oracle, strict=True) for x, y in zip(r, o, strict=True))
