"""Spark rows against DuckDB rows over the same tables."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if x is None:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)):
        return round(float(x), 6) + 0.0 if not math.isnan(x) else "nan"
    if isinstance(x, (list, tuple)):
        return tuple(map(cell, x))
    return str(getattr(x, "replace", lambda **_: x)(tzinfo=None)) if hasattr(x, "tzinfo") else str(x) if not isinstance(x, str) else x


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def oracle(sf, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = con.execute(sql)
    return table([c[0] for c in got.description], got.fetchall())


def spark_rows(df):
    return table(df.columns, df.collect())
