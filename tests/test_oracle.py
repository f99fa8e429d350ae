"""Every query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from tidemark import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DIR = "/root/testdata/sf0.01"


def rows(df):
    df = df[sorted(df.columns)]
    cell = lambda x: None if x is None or x != x else round(float(x), 6) + 0.0 if isinstance(x, float) else str(x)
    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{DIR}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = core.QUERIES[name](spark, DIR).toPandas(), duck.execute(core.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def large_sales(where, copies=60):
    """A customer in each of five regions and an order a month of each: sales as high as in sf0.1 repeated 60 times, months that differ by a thousandth."""
    con = duckdb.connect()
    made = {
        "region": "SELECT CAST(i AS INTEGER) AS r_regionkey, 'R' || i AS r_name FROM range(5) t(i)",
        "nation": "SELECT CAST(i AS INTEGER) AS n_nationkey, 'N' || i AS n_name, CAST(i AS INTEGER) AS n_regionkey FROM range(5) t(i)",
        "customer": "SELECT i AS c_custkey, CAST(i AS INTEGER) AS c_nationkey FROM range(5) t(i)",
        "orders": f"SELECT 5 * m + i AS o_orderkey, i AS o_custkey, {copies} * (95e6 + 1e3 * ((37 * m * m + 11 * m * i + 53 * i) % 97)) AS o_totalprice, TIMESTAMP '1995-01-01' + to_months(CAST(m AS INTEGER)) AS o_orderdate FROM range(40) t(m), range(5) c(i)",
    }
    for t, sql in made.items():
        con.execute(f"COPY ({sql}) TO '{where}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["hierarchy_models", "hierarchy_models_reconciled"])
def test_models_of_large_sales_equal_sql(spark, tmp_path, name):
    duck = large_sales(tmp_path)
    got, want = core.QUERIES[name](spark, str(tmp_path)).toPandas(), duck.execute(core.SQL[name]).df()
    assert len(got) == 6 * 39 and rows(got) == rows(want)
