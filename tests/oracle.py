"""Rows of a Spark query beside those of its SQL in DuckDB."""

import os
from collections import Counter

import duckdb


def connect(folder):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for name in os.listdir(folder):
        c.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{folder}/{name}')")
    return c


def rows(table):
    names = sorted(table.column_names)
    return names, Counter(tuple(str(v).replace("+00:00", "") for v in r.values()) for r in table.select(names).to_pylist())
