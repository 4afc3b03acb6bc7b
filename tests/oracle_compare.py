"""Test helper: compare a Spark result with a DuckDB result (rows, columns, values).

Used by the tests. Values are compared after sorting columns by name and rows
by all columns, with dates and timestamps normalised to Python objects.
"""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def duckdb_con(sf_dir: str, tables: tuple[str, ...] = TABLES) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime()
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except (ValueError, AttributeError):
            return v
    return v


def rows_of(records: list[tuple], columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0)
                                           for x in t))


def compare(spark_df, con: duckdb.DuckDBPyConnection, sql: str, rel_tol: float = 0.0):
    """Return a list of mismatch descriptions (empty when equal)."""
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns differ: spark={sorted(s_cols)} duckdb={sorted(d_cols)}")
        return problems
    if len(s_rows) != len(d_rows):
        problems.append(f"row count differs: spark={len(s_rows)} duckdb={len(d_rows)}")
    a = rows_of(s_rows, s_cols)
    b = rows_of(d_rows, d_cols)
    names = sorted(s_cols)
    bad = 0
    for ra, rb in zip(a, b):
        for name, x, y in zip(names, ra, rb):
            same = x == y
            if not same and rel_tol and isinstance(x, float) and isinstance(y, float):
                same = math.isclose(x, y, rel_tol=rel_tol, abs_tol=rel_tol)
            if not same:
                bad += 1
                if bad <= 5:
                    problems.append(f"value differs in {name}: spark={x!r} duckdb={y!r}")
    if bad > 5:
        problems.append(f"... {bad} differing values in total")
    return problems
