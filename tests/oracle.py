"""Compares a registered query with its SQL, as the driver does."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def plain(v):
    if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, (float, np.floating)):
        return f"{v:.9g}"
    return str(v)


def rows(df):
    columns = sorted(df.columns)
    return sorted(tuple(map(plain, r)) for r in df[columns].astype(object).itertuples(index=False, name=None))


def same(spark, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = query(spark, DATA).toPandas(), con.execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
