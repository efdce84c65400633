"""Rows of Spark and DuckDB, made comparable."""

import os
from decimal import Decimal

import duckdb


def connect(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return con


def plain(v):
    if v is None or v != v:
        return "-"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, Decimal)):
        return repr(round(float(v), 5) + 0.0)
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in data)


def of_spark(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def of_duckdb(con, sql):
    cur = con.execute(sql)
    return rows([d[0] for d in cur.description], cur.fetchall())
