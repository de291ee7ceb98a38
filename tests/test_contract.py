"""Every contract query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tablemere.plans import contract

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def rows(df):
    cell = lambda x: None if pd.isna(x) else f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted([tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False)], key=str)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, duck, name):
    mine, want = contract.queries()[name](spark, DIR).toPandas(), duck.execute(contract.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(want.columns)
    assert rows(mine) == rows(want)


@pytest.mark.parametrize("keys", [[92233, 92234], [-92233, -92234], [899999, None, -5, 14999], [2**63 - 1, 2**63 - 1, 1], [-(2**63), -1], list(range(0, 900000, 10007))])
def test_sum_int64_wrap_of_large_keys(spark, tmp_path, keys):
    name, path = "sum_int64_wrap", f"{tmp_path}/orders.parquet"
    pd.DataFrame({"o_orderkey": range(len(keys)), "o_custkey": pd.array(keys, "Int64")}).to_parquet(path)
    want = duckdb.sql(contract.oracle_sql()[name].replace("FROM orders", f"FROM read_parquet('{path}')")).fetchall()
    assert [tuple(r) for r in contract.queries()[name](spark, str(tmp_path)).collect()] == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["l_suppkey", "trip_count", "avg_fare"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
