"""Rows of a query and of its SQL twin in one comparable form."""

import decimal
import math

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if x is None or str(x) in ("NaT", "<NA>") or (isinstance(x, float) and math.isnan(x)):
        return "~"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, float, np.integer, np.floating, decimal.Decimal)):
        return f"{float(x) + 0.0:.9g}"
    return str(x)


def rows(frame):
    return sorted(tuple(plain(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False))
