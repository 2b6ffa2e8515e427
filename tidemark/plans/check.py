"""Compare a registered query with its SQL twin in an in-process DuckDB."""

from __future__ import annotations

import math
import os

from tidemark.plans.views import TABLES


def _norm(value):
    if value is None:
        return None
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.9g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_norm(v) for v in value)
    return value


def _key(row):
    return tuple((v is None, str(type(v).__name__), str(v)) for v in row)


def duck_rows(sql: str, folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    rows = cur.fetchall()
    con.close()
    return names, rows


def compare(df, sql: str, folder: str) -> str | None:
    """``None`` when names, row count and values agree, else a short description of the difference."""
    cols = sorted(df.columns)
    got = [tuple(_norm(r[c]) for c in cols) for r in df.select(*cols).collect()]
    names, rows = duck_rows(sql, folder)
    if sorted(names) != cols:
        return f"columns differ: {cols} vs {sorted(names)}"
    idx = [names.index(c) for c in cols]
    want = [tuple(_norm(r[i]) for i in idx) for r in rows]
    if len(got) != len(want):
        return f"row counts differ: {len(got)} vs {len(want)}"
    got.sort(key=_key)
    want.sort(key=_key)
    for g, w in zip(got, want):
        if g != w:
            if any(type(a) is not type(b) and a is not None and b is not None for a, b in zip(g, w)):
                return f"types differ: {dict(zip(cols, g))} vs {dict(zip(cols, w))}"
            return f"values differ: {dict(zip(cols, g))} vs {dict(zip(cols, w))}"
    return None
