"""Rows of a Spark query against rows of DuckDB's SQL on the same Parquet files."""

import glob
import os

import duckdb

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(directory):
    con = duckdb.connect()
    for name in NAMES:
        path = f"{directory}/{name}.parquet"
        if glob.glob(path):
            files = f"{path}/*.parquet" if os.path.isdir(path) else path
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{files}'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, bool) or v is None:
            return repr(v)
        if isinstance(v, (int, float)) and float(v) == int(v) and abs(v) < 2**53:
            return repr(int(v))
        return repr(round(v, 9)) if isinstance(v, float) else repr(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def compare(spark, con, fn, sql, directory):
    """'' if both give the same columns and rows, else what differs."""
    df = fn(spark, directory)
    a, ca = normal([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    b, cb = normal(cur.fetchall(), [d[0] for d in cur.description])
    if ca != cb:
        return f"columns {ca} {cb}"
    if a == b:
        return "" if a else "no rows"
    only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
    return f"{len(a)} rows, SQL {len(b)}; only Spark: {str(only_a)[:300]}; only SQL: {str(only_b)[:300]}"
