"""Runs a query and its SQL over the same tables and compares the rows."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def normal(rows: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or isinstance(v, float) and np.isnan(v) or v is pd.NA or v is pd.NaT:
            return None
        if isinstance(v, (bool, np.bool_)):
            return bool(v)
        if isinstance(v, (int, float, np.integer, np.floating)):
            return round(float(v), 5) + 0.0
        return str(v)

    names = sorted(rows.columns)
    return sorted((tuple(plain(v) for v in row) for row in rows[names].itertuples(index=False)), key=repr)


def same(spark, sf_dir: str, name: str, build, sql: str) -> None:
    got = build(spark, sf_dir).toPandas()
    want = connection(sf_dir).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns), name
    assert normal(got) == normal(want), name
