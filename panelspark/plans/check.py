"""Compares registered queries with their SQL on DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(value):
    if value is None or isinstance(value, bool):
        return value
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(row[i]) for i in order) for row in rows]
    out.sort(key=lambda t: tuple((v is None, str(type(v)), str(v)) for v in t))
    return [columns[i] for i in order], out


def differences(spark, name: str, build, sql: str, sf_dir: str, con) -> list[str]:
    """Empty when columns, row counts, types and values agree."""
    df = build(spark, sf_dir)
    got_cols, got = rows_of(df.columns, df.collect())
    rel = con.sql(sql)
    want_cols, want = rows_of(rel.columns, rel.fetchall())
    problems = []
    if got_cols != want_cols:
        return [f"columns {got_cols} != {want_cols}"]
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    bad = [(g, w) for g, w in zip(got, want) if g != w or any(
        type(a) is not type(b) for a, b in zip(g, w))]
    if bad:
        problems.append(f"{len(bad)} of {len(want)} rows differ, first {bad[0]}")
    return problems
