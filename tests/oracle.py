"""Spark and DuckDB side by side on the driver's tables."""

import os

import duckdb

SF = "/root/testdata/sf0.01"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir=SF):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def compare(df, con, sql):
    """Rows of both with columns by name, as sorted text."""
    cols = sorted(df.columns)
    ours = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols, (names, cols)
    order = [names.index(c) for c in cols]
    theirs = sorted(repr(tuple(r[i] for i in order)) for r in cur.fetchall())
    return ours, theirs
