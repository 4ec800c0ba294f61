"""Compare a registered query with its SQL on the same Parquet tables."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (decimal.Decimal, int, float)):
        return float(f"{float(v):.10g}")
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=lambda t: tuple((x is None, str(x)) for x in t))


def difference(df, con, sql: str) -> str | None:
    """None when both sides agree, otherwise what differs."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    want = _rows(names, result.fetchall())
    have = _rows(df.columns, [tuple(r) for r in df.collect()])
    if len(want) != len(have):
        return f"{len(have)} rows against {len(want)}; {have[:2]} {want[:2]}"
    for a, b in zip(have, want):
        if a != b:
            return f"{a} against {b}"
    return None
