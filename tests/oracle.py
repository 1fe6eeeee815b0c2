"""Run a registered query beside its oracle and compare whole results."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return repr(v)


def _rows(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both sides agree, else a short description of the difference."""
    got_cols, got = _rows(spark_df.columns, spark_df.collect())
    rel = con.execute(sql)
    want_cols, want = _rows([d[0] for d in rel.description], rel.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        extra = set(got) - set(want)
        missing = set(want) - set(got)
        return f"rows {len(got)} != {len(want)}; extra {str(list(extra)[:2])[:400]}; missing {str(list(missing)[:2])[:400]}"
    for g, w in zip(got, want):
        if g != w:
            bad = [(c, a[:300], b[:300]) for c, a, b in zip(got_cols, g, w) if a != b]
            return f"first difference at {g[:1]}: {bad}"
    return None
