"""Run a query on Spark and its SQL twin on DuckDB and compare the rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "asDict"):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if type(v).__name__ == "Decimal":
        return float(f"{float(v):.9g}")
    return v


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        at = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"create view {p.stem} as select * from read_parquet('{at}')")
    return con


def compare(df, sql: str, con) -> str:
    """'' if equal, else what differs."""
    columns = sorted(df.columns)
    got = df.select(*columns).collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}"
    order = [names.index(c) for c in columns]
    want = Counter(tuple(_plain(r[i]) for i in order) for r in cur.fetchall())
    have = Counter(tuple(_plain(v) for v in r) for r in got)
    if want == have:
        return ""
    return f"spark {sum(have.values())} rows, sql {sum(want.values())}; only spark {list((have - want).items())[:4]}; only sql {list((want - have).items())[:4]}"
