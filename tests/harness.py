"""Compare registered queries with their DuckDB oracles, the way a reader of both would: rows, types, values."""
from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(d: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19].replace("T00:00:00", "")
    return v


SAME = {"double": "DOUBLE", "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "date": "DATE", "boolean": "BOOLEAN",
        "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP"}


def compare(spark, con, d, query, sql):
    """Return (ok, message, seconds)."""
    start = time.time()
    df = query(spark, d)
    rows = df.collect()
    took = time.time() - start
    if sql is None:
        return True, f"{len(rows)} rows, no oracle", took
    rel = con.sql(sql)
    cols = sorted(df.columns)
    if cols != sorted(rel.columns):
        return False, f"columns differ: {sorted(set(cols) ^ set(rel.columns))}", took
    types = dict(zip(rel.columns, map(str, rel.types)))
    off = [(c, t, types[c]) for c, t in df.dtypes if SAME.get(t, t) != types[c]]
    if off:
        return False, f"types differ: {off[:6]}", took
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in rows), key=repr)
    if len(got) != len(want):
        return False, f"{len(got)} rows, expected {len(want)}", took
    bad = [(c, g[i], w[i]) for g, w in zip(got, want) if g != w for i, c in enumerate(cols) if g[i] != w[i]]
    return (not bad), (f"{len(got)} rows" if not bad else f"{len(bad)} cells differ, first {bad[:3]}"), took


def session():
    import tempfile

    from pyspark.sql import SparkSession
    return (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
            .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
            .config("spark.driver.host", "127.0.0.1").getOrCreate())


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    import __spark_entry__ as entry
    picks = sys.argv[2:]
    d = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con, qs, os_ = duck(d), entry.queries(), entry.oracle_sql()
    bad = 0
    for name, q in qs.items():
        if picks and not any(name.startswith(p) for p in picks):
            continue
        try:
            ok, msg, took = compare(spark, con, d, q, os_.get(name))
        except Exception as e:  # noqa: BLE001
            ok, msg, took = False, f"{type(e).__name__}: {str(e)[:700]}", 0.0
        bad += not ok
        if not ok or "-v" not in picks:
            print(f"{'ok ' if ok else 'BAD'} {name:34s} {took:5.1f}s {msg}", flush=True)
    print(f"{bad} bad", flush=True)
