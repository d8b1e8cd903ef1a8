"""Run a query and its SQL on the same tables and compare all values."""

from __future__ import annotations

import math
import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    if isinstance(v, np.ndarray):
        return str(v.tolist())
    return int(v) if isinstance(v, (int, np.integer)) and not isinstance(v, bool) else v


def rows(pdf: pd.DataFrame) -> list[list]:
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted(([plain(v) for v in r] for r in pdf.itertuples(index=False)), key=lambda r: [(x is None, str(x)) for x in r])


def same(spark_pdf: pd.DataFrame, sql_pdf: pd.DataFrame) -> None:
    assert sorted(spark_pdf.columns) == sorted(sql_pdf.columns)
    assert len(spark_pdf) == len(sql_pdf)
    for a, b in zip(rows(spark_pdf), rows(sql_pdf), strict=True):
        assert a == b
