"""Compares a query with its DuckDB counterpart."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def database(sf: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    return con


def _plain(df: pd.DataFrame) -> list[tuple]:
    out = []
    for row in df[sorted(df.columns)].itertuples(index=False):
        out.append(tuple("null" if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in row))
    return sorted(out)


def assert_same(spark_rows, sql: str, con: duckdb.DuckDBPyConnection) -> None:
    left, right = spark_rows.toPandas(), con.execute(sql).df()
    for df in (left, right):
        for c in df.columns:
            if str(df[c].dtype) in ("Int64", "Int32", "boolean") or df[c].dtype.kind in "iu":
                df[c] = df[c].map(lambda v: None if v is pd.NA or v is None else v).astype(object)
    assert sorted(left.columns) == sorted(right.columns)
    fix = lambda rows: [tuple(x.removesuffix(".0") if x.replace(".", "", 1).replace("-", "", 1).isdigit() else x for x in r) for r in rows]
    assert fix(_plain(left)) == fix(_plain(right))
