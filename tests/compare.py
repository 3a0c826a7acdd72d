"""Holds a query's rows against its SQL run by DuckDB on the same tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def plain(v):
    """A value that can be compared and sorted: no negative zero, floats to nine digits."""
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float):
        return (2, "nan") if math.isnan(v) else (2, f"{v + 0.0:.9g}" if v else "0")
    if isinstance(v, int):
        return (2, f"{v:.9g}" if abs(v) < 10**8 else str(v))
    if isinstance(v, (list, tuple)):
        return (3, str([plain(x) for x in v]))
    if isinstance(v, dict):
        return (3, str([(k, plain(x)) for k, x in v.items()]))
    return (4, str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def differences(df, sql: str, con) -> list[str]:
    """What differs, in words; an empty list if nothing does."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    got = rows_of(df.columns, df.collect())
    out = []
    if sorted(names) != sorted(df.columns):
        out.append(f"columns: {sorted(df.columns)} but {sorted(names)} wanted")
    if len(got) != len(want):
        out.append(f"rows: {len(got)} but {len(want)} wanted")
    if not out:
        bad = [(a, b) for a, b in zip(got, want) if a != b]
        if bad:
            out.append(f"{len(bad)} of {len(got)} rows differ, first {bad[0]}")
    return out
