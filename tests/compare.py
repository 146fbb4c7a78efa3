"""Rows of a query and of its SQL in DuckDB, made comparable."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES.split():
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        return float(x) if x % 1 else int(x)
    if isinstance(x, float):
        return round(x, 9)
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr), [names[i] for i in order]


def of_spark(frame):
    return rows(frame.columns, [tuple(r) for r in frame.collect()])


def of_duck(con, sql):
    got = con.sql(sql)
    return rows(got.columns, got.fetchall())


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def types(frame, con, sql):
    """Columns whose types differ between Spark and DuckDB."""
    got = con.sql(sql)
    duck = dict(zip(got.columns, map(str, got.types), strict=True))
    return {c: (t, duck.get(c)) for c, t in frame.dtypes if KINDS.get(t, t) != duck.get(c)}
