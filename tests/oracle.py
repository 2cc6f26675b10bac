"""Runs a query and its DuckDB SQL on the same tables and compares the rows."""

from __future__ import annotations

import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def connect(d: str = SMALL) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for name in os.listdir(d):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{d}/{name}'")
    return c


def rows(c: duckdb.DuckDBPyConnection, sql: str, columns: list[str], kinds: list) -> list[str]:
    shown = [f'round("{n}"::DOUBLE, 6) AS "{n}"' if "DOUBLE" in str(k) or "DECIMAL" in str(k) else f'"{n}"' for n, k in zip(columns, kinds)]
    return sorted(map(repr, c.execute(f"SELECT {', '.join(shown)} FROM ({sql})").fetchall()))


def same(df, sql: str, out: str, d: str = SMALL) -> None:
    df.write.mode("overwrite").parquet(out)
    c = connect(d)
    want = c.sql(sql)
    assert sorted(want.columns) == sorted(df.columns)
    expected = rows(c, sql, want.columns, want.types)
    assert rows(c, f"SELECT * FROM '{out}/*.parquet'", want.columns, want.types) == expected
