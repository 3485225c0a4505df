"""Run a query and its SQL oracle on the same tables and compare the bags of rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def cell(value):
    """Floats to 11 significant digits, anything else as text."""
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value:.11g}" if value else "0"
    return None if value is None else str(value)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str:
    """Empty when equal, else the first differences."""
    got_cols, got = bag(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want_cols, want = bag(cols, cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if got == want:
        return ""
    return (
        f"rows {sum(got.values())} vs {sum(want.values())}; only here {list((got - want).items())[:3]}; "
        f"only in oracle {list((want - got).items())[:3]}"
    )
