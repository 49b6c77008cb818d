"""Compares a frame with DuckDB's rows: columns by name, rows in any order, values as text (floats to nine digits)."""

import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def text(x):
    if isinstance(x, bool) or x is None:
        return repr(x)
    return repr(round(float(x), 9)) if isinstance(x, int | float) else str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(text(r[i]) for i in order) for r in rows)


def assert_same(df, con, sql):
    cur = con.execute(sql)
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in cur.description], cur.fetchall())
