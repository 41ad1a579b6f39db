"""Comparison of a Spark result with DuckDB SQL over the same tables."""

from __future__ import annotations

import glob
import os

import duckdb


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(table) -> list[tuple]:
    names = sorted(table.column_names)
    cell = lambda v: "null" if v is None else repr(round(v, 9)) if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[n]) for n in names) for r in table.to_pylist())


def same(df, sql: str, folder: str) -> None:
    ours = df.toArrow()
    theirs = connection(folder).sql(sql).arrow()
    theirs = theirs.read_all() if hasattr(theirs, "read_all") else theirs
    assert sorted(ours.column_names) == sorted(theirs.column_names)
    assert rows(ours) == rows(theirs)
