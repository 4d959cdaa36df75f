"""Rows of a Spark result against those of a DuckDB query over the same tables."""

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, (float, np.floating)) and v != v):
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (bool, int, float, np.integer, np.floating, np.bool_)):
        return float(f"{float(v):.9g}")
    return str(v)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted((tuple(plain(x) for x in r) for r in frame[names].itertuples(index=False)), key=repr)
