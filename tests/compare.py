"""Compare a query's rows with DuckDB's: column names, row counts and values, whatever the order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p / '*.parquet' if p.is_dir() else p}'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


def check(df, con, sql: str) -> None:
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    assert sorted(df.columns) == sorted(names)
    want, have = rows(names, got.fetchall()), rows(df.columns, [tuple(r) for r in df.collect()])
    assert len(have) == len(want), f"{len(have)} rows, DuckDB has {len(want)}"
    bad = [(a, b) for a, b in zip(have, want, strict=True) if a != b and not all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 1.1e-6 * max(1, abs(x))) for x, y in zip(a, b, strict=True))]
    assert not bad, f"{len(bad)} of {len(have)} rows differ, first: {bad[0]}"
