"""Compares a query with its SQL on the same tables."""

from __future__ import annotations

import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(value):
    if isinstance(value, float):
        return round(value, 8)
    if isinstance(value, decimal.Decimal):
        return float(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def check(spark, query, sql: str, sf_dir: str) -> int:
    found = query(spark, sf_dir)
    own = rows_of(found.columns, found.collect())
    with duckdb.connect() as c:
        for t in TABLES:
            if os.path.exists(f"{sf_dir}/{t}.parquet"):
                c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        r = c.execute(sql)
        names = [x[0] for x in r.description]
        assert sorted(names) == sorted(found.columns)
        assert own == rows_of(names, r.fetchall())
    return len(own)
