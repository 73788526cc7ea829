"""Comparison of a query's rows with those of its SQL."""

import datetime
import glob
import os

import duckdb


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return f"{float(v):.9g}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(plain(r[i]) for i in order) for r in rows)


def connection(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con
