"""Runs a query in Spark and its SQL in DuckDB and compares all rows."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool):
        return x
    if hasattr(x, "as_integer_ratio"):
        return float(x)
    if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
        return tuple(_plain(y) for y in x)
    return str(x)


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in data), key=repr)


def compare(spark, con, sf_dir: str, query, sql: str) -> str:
    """'' if both give the same rows, else what differs."""
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} {sorted(names)}"
    if got != want:
        a, b = [x for x in got if x not in set(want)], [x for x in want if x not in set(got)]
        return f"{len(got)} and {len(want)} rows; {a[:3]} against {b[:3]}"
    return ""
