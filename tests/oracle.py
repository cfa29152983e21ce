"""Run a registered query on Spark and its oracle on DuckDB, and compare.

The comparison is order-insensitive and exact: rows are turned into tuples
of Python values (decimals stay ``Decimal``) and compared as multisets,
after checking both sides have the same column names.
"""

from __future__ import annotations

import collections
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def spark_rows(df):
    # Decimal equality and hashing are by value (1.50 == 1.5), so values compare as they are.
    cols = df.columns
    return cols, [tuple(r[c] for c in cols) for r in df.collect()]


def duck_rows(con, sql):
    rel = con.sql(sql)
    cols = list(rel.columns)
    return cols, [tuple(row) for row in rel.fetchall()]


def compare(spark, con, name, query, sql, sf_dir):
    s_cols, s_rows = spark_rows(query(spark, sf_dir))
    d_cols, d_rows = duck_rows(con, sql)
    problems = []
    if sorted(c.lower() for c in s_cols) != sorted(c.lower() for c in d_cols):
        problems.append(f"columns differ: spark={s_cols} duckdb={d_cols}")
        return problems, len(s_rows), len(d_rows)
    order = [d_cols.index(c) if c in d_cols else [x.lower() for x in d_cols].index(c.lower()) for c in s_cols]
    d_rows = [tuple(r[i] for i in order) for r in d_rows]
    cs, cd = collections.Counter(s_rows), collections.Counter(d_rows)
    if cs != cd:
        only_s = list((cs - cd).elements())[:5]
        only_d = list((cd - cs).elements())[:5]
        problems.append(f"rows differ ({len(s_rows)} vs {len(d_rows)}); spark-only {only_s}; duckdb-only {only_d}")
    return problems, len(s_rows), len(d_rows)
