"""Spark results against DuckDB over the same tables."""

from pathlib import Path

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(v[i] for i in order) for v in values), key=repr)


def check(df, c, sql):
    other = c.sql(sql)
    assert sorted(df.columns) == sorted(other.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(other.columns, other.fetchall())
