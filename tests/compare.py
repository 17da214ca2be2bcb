"""Compare a Spark result with DuckDB's, without regard to order."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (not isinstance(v, (list, np.ndarray)) and pd.isna(v)):
        return "null"
    if isinstance(v, (float, int, np.integer, np.floating)) and not isinstance(v, (bool, np.bool_)):
        return repr(round(float(v), 9) + 0.0)
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(_plain, r)) for r in df.itertuples(index=False))


def same(spark_df, duck_df):
    mine = spark_df.toPandas()
    assert sorted(mine.columns) == sorted(duck_df.columns)
    assert rows(mine) == rows(duck_df)
