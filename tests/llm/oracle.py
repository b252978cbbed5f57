"""Compare a registered query with its SQL in DuckDB, or with rows made by hand."""

import duckdb

TABLES = "documents embeddings pages benchmark labels".split()


def by_sql(sql, sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = c.sql(sql)
    return rel.columns, rel.fetchall()


def same(df, sql, sf_dir):
    columns, want = by_sql(sql, sf_dir)
    names = sorted(columns)
    assert sorted(df.columns) == names
    got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)
    at = [columns.index(n) for n in names]
    want = sorted((tuple(r[i] for i in at) for r in want), key=str)
    assert len(got) == len(want)
    assert got == want
    return got
