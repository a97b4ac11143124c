"""Comparison of a Spark result with DuckDB's: columns, rows and values in any order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def value(v):
    if v is None or v != v:
        return None
    if hasattr(v, "item"):
        v = v.item()
    return round(v, 9) + 0.0 if isinstance(v, float) else str(v)


def rows(columns, data):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(value(r[i]) for i in at) for r in data], key=str)


def compare(df, con, sql):
    other = con.sql(sql)
    assert sorted(df.columns) == sorted(other.columns)
    mine, theirs = rows(df.columns, [tuple(r) for r in df.collect()]), rows(other.columns, other.fetchall())
    assert len(mine) == len(theirs)
    assert mine == theirs
