"""Compares a query with its oracle SQL, as multisets of rows."""

import math
import os
from collections import Counter
from glob import glob

import duckdb


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, Counter(tuple(_plain(row[c]) for c in columns) for row in df.collect())


def sql_rows(sql, folder):
    con = duckdb.connect()
    for path in glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    return columns, Counter(tuple(_plain(row[k]) for k in at) for row in found.fetchall())
