"""Row-set comparison between a Spark result and its SQL counterpart."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set enable_progress_bar = false")
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {name} as select * from '{path}'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return ("n", f"{float(v):.6f}") if isinstance(v, (float, decimal.Decimal)) else ("i", v)
    if isinstance(v, (dt.datetime, dt.date)):
        return ("t", v.isoformat())
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return ("s", str(v))


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def diff(df, con, sql):
    """None when equal, else a short description."""
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want_rows = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    got, want = normalise(df.columns, rows), normalise(names, want_rows)
    if got == want:
        return None if got else "EMPTY on both sides"
    g, w = set(map(repr, got)), set(map(repr, want))
    return f"{len(got)} vs {len(want)} rows; only spark: {sorted(g - w)[:2]}; only sql: {sorted(w - g)[:2]}"
