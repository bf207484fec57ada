"""The oracles of every registered query are SQL that DuckDB runs."""

import __spark_entry__
import duckdb

SF = "/root/testdata/sf0.001"


def test_every_oracle_runs():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = __spark_entry__.oracle_sql()
    assert set(found) <= set(__spark_entry__.queries())
    assert not [k for k, v in found.items() if not isinstance(v, str)]
    for v in found.values():
        c.execute(v).fetchone()
