"""Runs a query and its SQL on the same tables and compares rows."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return f"{x:.9g}"
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return str(x)


def rows_of_sql(sf_dir: str, sql: str) -> tuple[list[str], list]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(row[i]) for i in order) for row in r.fetchall())


def rows_of_spark(df) -> tuple[list[str], list]:
    names = sorted(df.columns)
    return names, sorted(tuple(plain(v) for v in row) for row in df.select(*names).collect())


def compare(spark, sf_dir: str, query, sql: str) -> str:
    a, b = rows_of_spark(query(spark, sf_dir)), rows_of_sql(sf_dir, sql)
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if a[1] != b[1]:
        one = [x for x in a[1] if x not in set(b[1])][:2], [x for x in b[1] if x not in set(a[1])][:2]
        return f"{len(a[1])} and {len(b[1])} rows; only in Spark and only in SQL: {str(one)[:700]}"
    return "" if a[1] else "no rows"
