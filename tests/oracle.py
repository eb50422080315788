"""Registered queries against their SQL in DuckDB."""

import os

import duckdb

SF = os.environ.get("XYLEM_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _plain(rows):
    return sorted(tuple("" if x is None else repr(float(x)) if isinstance(x, float) else repr(x) for x in r) for r in rows)


def assert_same(spark, con, query, sql):
    df = query(spark, SF)
    columns = sorted(df.columns)
    have = _plain(df.select(columns).collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = _plain([[r[i] for i in at] for r in cursor.fetchall()])
    assert have == want
