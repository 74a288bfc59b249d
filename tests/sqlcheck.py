"""Holds a query's rows against its SQL twin in DuckDB."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql: str, sf_dir: str = DATA) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con.sql(sql).df()


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    cols = sorted(got.columns)
    plain = lambda df: df[cols].astype(object).where(df[cols].notna(), None).map(lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, plain(got).to_numpy().tolist()), key=key) == sorted(map(tuple, plain(want).to_numpy().tolist()), key=key)
