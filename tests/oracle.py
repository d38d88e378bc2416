"""Compare registered queries with their oracle SQL.

    python tests/oracle.py [--sf DIR] [name-or-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return _plain(value.asDict())
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return f"{type(value).__name__}:{value}"


def normal_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([_plain(r[i]) for i in order]) for r in rows)


def compare(spark, con, folder, run, sql):
    """(spark rows, oracle rows, problem or None, seconds in Spark, in DuckDB)."""
    t = time.time()
    df = run(spark, folder)
    rows = df.collect()
    spark_seconds = time.time() - t
    plan = df._jdf.queryExecution().executedPlan().toString()
    crossed = [op for op in ("CartesianProduct", "BroadcastNestedLoopJoin") if op in plan]
    if crossed:
        return len(rows), None, f"plan has {crossed}", spark_seconds, 0.0
    if sql is None:
        return len(rows), None, None, spark_seconds, 0.0
    t = time.time()
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    expected = cur.fetchall()
    oracle_seconds = time.time() - t
    problem = None
    if sorted(columns) != sorted(df.columns):
        problem = f"columns {sorted(df.columns)} vs {sorted(columns)}"
    else:
        a, b = normal_rows(df.columns, rows), normal_rows(columns, expected)
        if a != b:
            only_a = sorted(set(a) - set(b))[:3]
            only_b = sorted(set(b) - set(a))[:3]
            problem = f"values differ\n   spark : {only_a}\n   oracle: {only_b}"
    return len(rows), len(expected), problem, spark_seconds, oracle_seconds


def main() -> int:
    from lensmere.plans.registry import registry
    from lensmere.session import local_session

    args = sys.argv[1:]
    folder = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        folder, args = args[1], args[2:]
    spark, con, bad = local_session("oracle"), connect(folder), 0
    for name, (run, sql) in registry().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        try:
            n, m, problem, ts, td = compare(spark, con, folder, run, sql)
        except Exception as error:  # report and go on with the next query
            n = m = 0
            problem, ts, td = f"{type(error).__name__}: {str(error)[:1500]}", 0, 0
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} rows={n}/{m} {ts:.1f}s/{td:.1f}s "
              f"{problem or ''}", flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
