"""Rows of Spark and of DuckDB, in a form that can be compared."""

import glob
import math
import os

import duckdb


def plain(x):
    if isinstance(x, float) and math.isnan(x):
        return None
    return x.item() if hasattr(x, "item") else x


def connection(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(repr(tuple(plain(row[n]) for n in names)) for row in df.collect())


def duck_rows(con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    at = [names.index(n) for n in sorted(names)]
    return sorted(names), sorted(repr(tuple(plain(row[i]) for i in at)) for row in result.fetchall())
