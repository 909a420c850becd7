"""Every query with SQL gives the rows of its SQL."""

import os

import duckdb
import pytest

import __spark_entry__

QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    for f in os.listdir(tables):
        con.sql(f"create view {f.split('.')[0]} as from '{tables}/{f}'")
    return con


def test_sql_names_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal(spark, tables, duck, tmp_path, name):
    df = QUERIES[name](spark, tables)
    df.write.parquet(f"file://{tmp_path}/out")
    duck.sql(f"create or replace temp table want as {SQL[name]}")
    want = duck.sql("from want limit 0")
    assert sorted(want.columns) == sorted(df.columns)
    cols = ", ".join(f'round("{c}", 4) "{c}"' if str(t) in ("DOUBLE", "FLOAT") else f'"{c}"' for c, t in zip(want.columns, want.types))
    for a, b in (("want", f"'{tmp_path}/out/*.parquet'"), (f"'{tmp_path}/out/*.parquet'", "want")):
        assert duck.sql(f"select count(*) from (select {cols} from {a} except all select {cols} from {b})").fetchall() == [(0,)]
