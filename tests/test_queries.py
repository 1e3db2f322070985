"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from seqsieve.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    def plain(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return None
        if isinstance(v, (bool, np.bool_)):
            return bool(v)
        if isinstance(v, (int, float, np.number)):
            return round(float(v), 6) + 0.0
        return str(v)

    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, FOLDER).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    row = __spark_entry__.entry(spark).collect()[0]
    assert row.sig == "red_sum" and 0 < row.p_raw <= 1 and row.k_sur == 200
