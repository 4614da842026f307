"""Rows of a Spark result and of a SQL result in one comparable form."""

from __future__ import annotations

import os

import duckdb
import pandas as pd


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return c


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list):
        return tuple(plain(x) for x in v)
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
        return None
    return round(v, 9) if isinstance(v, float) else v


def rows(df: pd.DataFrame) -> list[tuple]:
    columns = sorted(df.columns)
    return sorted((tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False)), key=repr)


def assert_same(spark_df, sql: str, con: duckdb.DuckDBPyConnection) -> None:
    got, want = spark_df.toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a = [tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r) for r in rows(got)]
    b = [tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r) for r in rows(want)]
    assert sorted(a, key=repr) == sorted(b, key=repr)
