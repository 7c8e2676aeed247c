"""Comparison of a query with its SQL on the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(tuple(str(r[n]) for n in names) for r in table.to_pylist())


def assert_same(df, sql, sf_dir):
    got, expected = rows(df.toArrow()), rows(connect(sf_dir).sql(sql).to_arrow_table())
    assert got[0] == expected[0]
    assert got[1] == expected[1]
