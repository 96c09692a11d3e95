"""Run a registered query in Spark and in DuckDB and compare the whole results."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql) -> str | None:
    """None where both sides agree, else a short description."""
    got = spark_df.collect()
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    got_cols = spark_df.columns
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    for i, d in enumerate(cur.description):
        kind = str(d[1])
        if kind in ("HUGEINT",) or kind.startswith("DECIMAL") or kind.endswith("[]"):
            return f"column {d[0]} has type {kind}"
    a, b = rows_of(got_cols, got), rows_of(want_cols, want)
    if a == b:
        return None
    only_a, only_b = list((a - b).items())[:3], list((b - a).items())[:3]
    return f"rows {sum(a.values())} vs {sum(b.values())}; spark only {only_a}; sql only {only_b}"
