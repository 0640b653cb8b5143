"""Comparison of a query with its SQL: row count, column names and order-free values."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if hasattr(x, "isoformat"):
        return x.isoformat()
    if isinstance(x, int):
        return float(x) if abs(x) < 1 << 52 else x
    if isinstance(x, float):
        return float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    return x


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return Counter(tuple(_plain(r[k]) for k in order) for r in rows)


def oracle(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return names, cursor.fetchall()


def difference(frame, sql: str, sf_dir: str) -> str:
    """Empty if both agree."""
    names, rows = oracle(sql, sf_dir)
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} against {sorted(names)}"
    mine, other = rows_of(frame.columns, frame.collect()), rows_of(names, rows)
    if mine == other:
        return ""
    a, b = list((mine - other).items())[:3], list((other - mine).items())[:3]
    return f"{sum(mine.values())} and {sum(other.values())} rows; only Spark {a}; only SQL {b}"
