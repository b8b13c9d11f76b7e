"""Every query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tellurion.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (not isinstance(v, (list, dict, str)) and pd.isna(v)):
        return "~"
    return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def table(df):
    df = df[sorted(df.columns)].copy()
    for k in df.columns:
        df[k] = df[k].map(plain)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, db, name):
    got, want = table(catalogue.QUERIES[name](spark, SF).toPandas()), table(db.execute(catalogue.ORACLES[name]).df())
    pd.testing.assert_frame_equal(got, want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
