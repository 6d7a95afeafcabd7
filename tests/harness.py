"""Compare a registered Spark query with its DuckDB oracle SQL."""

from __future__ import annotations

import math

import duckdb

from tokloom.sources.tables import TABLES, table_path


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if not math.isfinite(v):
            return str(v)
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(names: list[str], rows) -> list[tuple]:
    """Rows as Python values, columns by name; NaN and NULL stay apart."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_norm(rec[i]) for i in order) for rec in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, name: str, sf_dir: str, builder, sql: str):
    sdf = builder(spark, sf_dir)
    con = duck(sf_dir)
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    assert sorted(sdf.columns) == sorted(cols), (name, sdf.columns, cols)
    a, b = rows_of(sdf.columns, sdf.collect()), rows_of(cols, rel.fetchall())
    assert len(a) == len(b), (name, len(a), len(b))
    mism = [(x, y) for x, y in zip(a, b) if x != y]
    assert not mism, (name, len(mism), mism[:3])
    return len(a)
