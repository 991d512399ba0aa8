"""Compare the registered queries with their SQL on one data directory."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = Path(sf_dir) / f"{table}.parquet"
        if path.exists():
            con.execute(f"create view {table} as select * from '{path}'")
    return con


def _sort_key(row: tuple) -> tuple:
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def _rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=_sort_key)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=0, abs_tol=1.0000001e-6) if a != b else True
    return a == b


def difference(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None if both give the same rows, else what differs first."""
    df = query(spark, sf_dir)
    ours = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = _rows(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows / {len(theirs)} rows"
    exact = sum(a == b for a, b in zip(ours, theirs))
    for a, b in zip(ours, theirs):
        if not all(_same(x, y) for x, y in zip(a, b)):
            return f"{exact}/{len(ours)} equal; first difference {a} / {b}"
    return None if exact == len(ours) else f"{exact}/{len(ours)} equal, rest within 1e-6"
