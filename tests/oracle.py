"""Compare a Spark query with its SQL in DuckDB, as bags of rows."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return con


def bag(rows, columns) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows)


def same(df, sql: str, con: duckdb.DuckDBPyConnection) -> int:
    """Asserts equal names and rows; gives the number of rows."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    got, want = bag(df.collect(), df.columns), bag(found.fetchall(), names)
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
    return sum(got.values())
