"""Every registered query runs on sf0.001, and those with SQL give what DuckDB gives."""

import duckdb
import pytest

from loomstone.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    rows = sorted(map(str, (tuple(r) for r in df.collect())))
    if name not in ORACLE_SQL:
        assert df.columns
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(f"SELECT {', '.join(f'"{c}"' for c in df.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert rows == sorted(map(str, want))
