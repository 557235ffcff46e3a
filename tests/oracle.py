"""Compare queries with their SQL: python tests/oracle.py SF NAME..."""

from __future__ import annotations

import datetime
import math
import os


def connect(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        p = f"{sf}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if hasattr(v, "as_integer_ratio") and not isinstance(v, (int, bool)):
        return float(v)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, name: str, query, sql: str, sf: str) -> str | None:
    """None if both give the same columns and rows, else what differs."""
    df = query(spark, sf)
    got = rows(df.columns, df.collect())
    cur = connect(sf).execute(sql)
    names = [c[0] for c in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"{name}: columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        diff = [(a, b) for a, b in zip(got, want, strict=False) if a != b][:3]
        return f"{name}: {len(got)} and {len(want)} rows; {diff}"
    return None


if __name__ == "__main__":
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    q, o = e.queries(), e.oracle_sql()
    import time

    for n in sys.argv[2:] or list(o):
        t = time.time()
        try:
            bad = compare(s, n, q[n], o[n], sys.argv[1])
        except Exception as x:
            bad = f"{n}: {type(x).__name__} {str(x)[:600]}"
        print("ok " if bad is None else "BAD", n if bad is None else bad, round(time.time() - t, 1), flush=True)
