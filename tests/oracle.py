"""Holds a Spark result against DuckDB over the same tables."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    number = float(v)
    return int(number) if number.is_integer() and abs(number) > 2**40 else round(number, 9)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def duck(sql: str, sf_dir: str, tables: dict | None = None):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{(tables or {}).get(t) or f'{sf_dir}/{t}.parquet'}')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return names, rows(names, found.fetchall())


def agree(df, sql: str, sf_dir: str, tables: dict | None = None):
    names, expected = duck(sql, sf_dir, tables)
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == expected
