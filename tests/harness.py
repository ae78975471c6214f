"""Run a registered query on Spark and its SQL on DuckDB, and compare every value."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "∅nan" if math.isnan(v) else "f" + repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return type(v).__name__ + ":" + str(v)


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences as text; empty when columns, row count and all values agree."""
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    expected = rel.fetchall()
    got = spark_df.collect()
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(set(spark_df.columns) ^ set(names))}"]
    order = sorted(names)
    a = sorted(tuple(canon(row[c]) for c in order) for row in got)
    at = [names.index(c) for c in order]
    b = sorted(tuple(canon(row[i]) for i in at) for row in expected)
    out = []
    if len(a) != len(b):
        out.append(f"rows spark={len(a)} sql={len(b)}")
    if a != b:
        left, right = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
        bad = [order[i] for i in range(len(order)) if {x[i] for x in set(a) - set(b)} != {x[i] for x in set(b) - set(a)}]
        out.append(f"cols {bad} of {order}\n   spark only {len(set(a) - set(b))}: {left}\n   sql only {len(set(b) - set(a))}: {right}")
    return out
