"""Runs a query and its SQL over the same tables and compares their rows."""

import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def sql_rows(sql: str, sf_dir: str) -> pd.DataFrame:
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c.sql(sql).df()


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool) or str(type(v)).endswith("numpy.bool'>"):
        return str(bool(v))
    if isinstance(v, float) or "float" in str(type(v)):
        return f"{float(v):.5f}"
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False))


def whole(x: list[tuple]) -> list[tuple]:
    """Integers and doubles of one value look alike."""
    return sorted(tuple(f"{float(v):.5f}" if v.replace(".", "", 1).replace("-", "", 1).isdigit() and len(v) < 16 else v for v in r) for r in x)


def same(spark_df, sql: str, sf_dir: str) -> int:
    """The number of rows, which are equal."""
    got, want = spark_df.toPandas(), sql_rows(sql, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert whole(rows(got)) == whole(rows(want))
    return len(got)
