"""Run a registered query on Spark and its SQL on DuckDB and compare every row.

    python -m tests.compare [sf folder] [query ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from decimal import Decimal

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(shaped, key=repr)


def compare(spark, con, folder: str, name: str):
    """(problem or None, rows, spark seconds, sql seconds)."""
    from __spark_entry__ import oracle_sql, queries

    start = time.time()
    df = queries()[name](spark, folder)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    middle = time.time()
    sql = oracle_sql().get(name)
    if sql is None:
        return None, len(got[1]), middle - start, 0.0
    cursor = con.execute(sql)
    want = _rows([d[0] for d in cursor.description], cursor.fetchall())
    problem = None
    if got[0] != want[0]:
        problem = f"columns {got[0]} != {want[0]}"
    elif len(got[1]) != len(want[1]):
        problem = f"{len(got[1])} rows != {len(want[1])}"
    if problem is None or "rows" in problem:
        ours, theirs = set(got[1]), set(want[1])
        extra = [r for r in got[1] if r not in theirs][:3]
        lacking = [r for r in want[1] if r not in ours][:3]
        if extra or lacking:
            problem = f"{problem or 'values differ'}\n   spark {extra}\n   sql   {lacking}"
    return problem, len(got[1]), middle - start, time.time() - middle


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from postgrain.session import build_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.001"
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    bad = 0
    for name in args or queries():
        try:
            problem, rows, ours, theirs = compare(spark, con, folder, name)
        except Exception as error:
            problem, rows, ours, theirs = f"{type(error).__name__}: {str(error)[:1200]}", 0, 0, 0
        bad += problem is not None
        mark = "FAIL" if problem else "ok" if name in oracle_sql() else "rows"
        print(f"{mark:4} {name:28} {rows:7} rows {ours:6.2f}s sql {theirs:6.2f}s {problem or ''}", flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    main()
