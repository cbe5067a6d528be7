"""Rows of a Spark result and of DuckDB SQL over the same tables, in one form."""

import decimal
import math

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, np.floating, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, np.integer):
        return int(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    return v


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(map(plain, r))) for r in frame.itertuples(index=False, name=None))


def oracle(sql, data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c.sql(sql).df()
