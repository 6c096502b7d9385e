"""Rows of a Spark query against those of DuckDB SQL on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float) or hasattr(value, "as_tuple"):
        return round(float(value), 6) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def oracle_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = con.sql(sql)
    return sorted(found.columns), rows_of(found.columns, found.fetchall())


def assert_agrees(df, sql: str, sf_dir: str) -> None:
    columns, wanted = oracle_rows(sql, sf_dir)
    assert sorted(df.columns) == columns
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == wanted
