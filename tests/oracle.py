"""Comparison of a Spark query with DuckDB SQL over the same tables."""

import glob
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def connect(sf=SF):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "None"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(float(v))
    return str(v)


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(plain(v) for v in r) for r in pdf.itertuples(index=False))


def same(spark_df, sql, con):
    got, want = spark_df.toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def there():
    return bool(glob.glob(f"{SF}/*.parquet"))
