"""Compare one query with its SQL: same columns, same multiset of rows."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, Decimal):
        return ("decimal", str(value))
    return (type(value).__name__, value)


def differences(df, con, sql: str) -> str | None:
    result = con.execute(sql)
    theirs_names = [d[0] for d in result.description]
    if sorted(theirs_names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(theirs_names)}"
    order = sorted(df.columns)
    spots = [theirs_names.index(c) for c in order]
    ours = Counter(tuple(plain(row[c]) for c in order) for row in df.collect())
    theirs = Counter(tuple(plain(row[i]) for i in spots) for row in result.fetchall())
    if ours == theirs:
        return None
    return (
        f"{sum(ours.values())} vs {sum(theirs.values())} rows; "
        f"only ours {list((ours - theirs).items())[:2]}; "
        f"only theirs {list((theirs - ours).items())[:2]}"
    )
