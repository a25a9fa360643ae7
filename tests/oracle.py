"""Compares a Spark result with DuckDB's result of the counterpart SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*' if path.is_dir() else ''}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if isinstance(value, bool) or value is None:
        return str(value)
    return str(value)


def spark_rows(df) -> tuple[list[str], list]:
    names = sorted(df.columns)
    return names, sorted(tuple(plain(v) for v in r) for r in df.select(*names).collect())


def duck_rows(con, sql: str) -> tuple[list[str], list]:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())


def assert_same(df, con, sql: str) -> int:
    names, rows = spark_rows(df)
    other_names, other = duck_rows(con, sql)
    assert names == other_names
    assert len(rows) == len(other), (len(rows), len(other))
    wrong = [(a, b) for a, b in zip(rows, other, strict=True) if a != b]
    assert not wrong, (len(wrong), wrong[:3])
    return len(rows)
