"""Compare a query with its SQL: columns by name, rows as a multiset."""

from __future__ import annotations

import datetime as dt
import glob
import os
from collections import Counter
from decimal import Decimal

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def norm(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (float, Decimal)):
        v = float(v)
        return "nan" if v != v else v + 0.0
    if isinstance(v, dt.date) and not isinstance(v, dt.datetime):
        return dt.datetime(v.year, v.month, v.day)
    return v


def multiset(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(norm(r[i]) for i in order) for r in rows)


def difference(con, sql: str, df) -> str:
    """Empty when equal, else what differs."""
    cursor = con.execute(sql)
    want = multiset([c[0] for c in cursor.description], cursor.fetchall())
    got = multiset(df.columns, df.collect())
    if want[0] != got[0]:
        return f"columns: sql only {set(want[0]) - set(got[0])}, spark only {set(got[0]) - set(want[0])}"
    if want[1] == got[1]:
        return ""
    missing, extra = want[1] - got[1], got[1] - want[1]
    return (
        f"rows: sql {sum(want[1].values())}, spark {sum(got[1].values())}, "
        f"missing {sum(missing.values())}, extra {sum(extra.values())}; columns {want[0]}; "
        f"e.g. sql {next(iter(sorted(missing, key=str)), None)} spark {next(iter(sorted(extra, key=str)), None)}"
    )
