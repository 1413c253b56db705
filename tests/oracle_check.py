"""Run registered queries beside their DuckDB twins and compare the rows."""

from __future__ import annotations

import math
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, fn, sql: str) -> tuple[str, dict]:
    """Empty text when both engines return the same rows."""
    started = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    spent = time.time() - started
    started = time.time()
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rows_of(names, rel.fetchall())
    times = {"spark": round(spent, 2), "duckdb": round(time.time() - started, 2), "rows": sum(got.values())}
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}", times
    if got != want:
        only_got, only_want = got - want, want - got
        return (
            f"{sum(got.values())} against {sum(want.values())} rows; "
            f"only spark {list(only_got)[:3]}; only duckdb {list(only_want)[:3]}"
        ), times
    return "", times
