"""Compares a query with its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
import os


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def in_duckdb(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    found = con.sql(sql)
    return found.columns, found.fetchall()


def rows(columns: list[str], values) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    out = [tuple(plain(r[k]) for k in order) for r in values]
    return [columns[k] for k in order], sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def assert_same(df, sf_dir: str, sql: str) -> None:
    assert rows(df.columns, df.collect()) == rows(*in_duckdb(sf_dir, sql))
