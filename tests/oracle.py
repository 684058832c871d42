"""Spark results against DuckDB, order aside."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=str)


def compare(con, df, sql):
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = rows(cur.fetchall(), names)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want), f"{len(got)} rows, not {len(want)}"
    for g, w in zip(got, want, strict=True):
        assert g == w
    return len(got)
