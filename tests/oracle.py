"""Spark results against DuckDB's, whatever the order of rows and columns."""

from __future__ import annotations

import datetime
from typing import Any

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v: Any) -> Any:
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(map(plain, v))
    if isinstance(v, float | np.floating):
        return None if v != v else round(float(v), 9)
    if isinstance(v, np.integer):
        return int(v)
    if isinstance(v, pd.Timestamp | datetime.datetime):
        return str(pd.Timestamp(v).tz_localize(None))
    return v


def rows_of(df: DataFrame) -> list[tuple]:
    columns = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def duck_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted((tuple(plain(x[i]) for i in order) for x in r.fetchall()), key=repr)
