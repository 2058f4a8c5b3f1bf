"""Every registered query of the core against its SQL in DuckDB at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

from medloom import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in queries.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    def text(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        return str(v).removesuffix(".0")

    return sorted(tuple(text(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_matches_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_union_holds_all_customers(spark, duck):
    got = sorted(r.id for r in queries.table_union_aligned(spark, SF).select("id").collect())
    assert got == sorted(x for (x,) in duck.sql("SELECT c_custkey FROM customer UNION ALL SELECT s_suppkey FROM supplier").fetchall())
