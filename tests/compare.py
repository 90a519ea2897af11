"""Order-insensitive comparison of a Spark result with an independent engine's."""

import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def engine(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def value(x):
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and math.isnan(x):
        return None
    if hasattr(x, "item"):
        x = x.item()
    return round(x, 6) if isinstance(x, float) else x if isinstance(x, (int, bool, str)) else str(x)


def rows(df):
    columns = sorted(df.columns)
    plain = df[columns].astype(object)
    return columns, sorted((tuple(value(x) for x in r) for r in plain.itertuples(index=False, name=None)), key=str)
