"""Run registered queries next to their oracle SQL and compare rows.

    python tests/check_oracles.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from opinaria.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def plain(value):
    if value is None or isinstance(value, (bool, str, datetime.date)):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, connection, name, sf_dir):
    sql = entry.oracle_sql().get(name)
    if sql is not None:
        result = connection.execute(sql)
        columns = [d[0] for d in result.description]
        want = result.fetchall()
    t = time.time()
    df = entry.queries()[name](spark, sf_dir)
    got = df.collect()
    spent = time.time() - t
    if sql is None:
        return f"rows only ({len(got)})", spent, bool(got)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}", spent, False
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a == b:
        return f"ok ({len(a)})", spent, True
    diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
    return f"DIFFERENT {len(a)} vs {len(b)} rows; {sum(x != y for x, y in zip(a, b))} differ; first {str(diff)[:700]}", spent, False


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--cpus", default="8")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session("check", f"local[{args.cpus}]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{args.sf}/{name}.parquet'")
    bad = []
    for name in args.names or entry.queries():
        try:
            message, spent, good = compare(spark, connection, name, args.sf)
        except Exception as error:
            message, spent, good = f"{type(error).__name__}: {str(error)[:900]}", 0.0, False
        if not good:
            bad.append(name)
        print(f"{name:32s} {spent:6.1f}s  {message}", flush=True)
    print("bad:", bad)
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main())
