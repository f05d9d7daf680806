"""Rows of a query beside those of its SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")


def connection(data: Path = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for p in sorted(data.glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def canon(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: "~" if v is None or v != v else repr(round(v, 6)) if isinstance(v, float) else str(int(v)) if isinstance(v, bool) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    cur = con.execute(sql)
    columns = [x[0] for x in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(columns, cur.fetchall())
