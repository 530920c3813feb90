"""A query's rows against the rows of its SQL, without regard to order."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(df) -> list[str]:
    columns = sorted(df.columns)
    return sorted(repr(tuple(map(plain, r))) for r in df.select(*columns).collect())


def sql_rows(sql: str, sf: str) -> tuple[list[str], list[str]]:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    columns = sorted(con.sql(sql).columns)
    found = con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({sql})").fetchall()
    return columns, sorted(repr(tuple(map(plain, r))) for r in found)


def same(df, sql: str, sf: str) -> None:
    columns, expected = sql_rows(sql, sf)
    assert sorted(df.columns) == columns
    assert rows(df) == expected
