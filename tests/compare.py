"""Runs a query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, (datetime.datetime, pd.Timestamp)):
        return str(pd.Timestamp(value).tz_localize(None))
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    cursor = con.execute(sql)
    return [c[0] for c in cursor.description], cursor.fetchall()


def differences(df, sf_dir: str, sql: str) -> str:
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    columns, rows = duck(sf_dir, sql)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    theirs = rows_of(columns, rows)
    if mine == theirs:
        return ""
    ours, others = set(mine), set(theirs)
    a, b = [x for x in mine if x not in others][:3], [x for x in theirs if x not in ours][:3]
    return f"{len(mine)} rows against {len(theirs)}; only here {str(a)[:400]}; only there {str(b)[:400]}"
