"""Run registered queries next to their oracle SQL and compare all rows.

``python tests/compare.py [--sf 0.01] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def canonical(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return value + 0.0 if not value.is_integer() else int(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, name, queries, oracles):
    """(ok, message, seconds) of one query."""
    started = time.time()
    df = queries[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    seconds = time.time() - started
    if name not in oracles:
        return True, f"rows-only {len(got)}", seconds
    asked = time.time()
    cur = con.execute(oracles[name])
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}", seconds
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a == b:
        return True, f"{len(a)} rows, sql {time.time() - asked:.1f}s", seconds
    in_a, in_b = set(a), set(b)
    only_a = [r for r in a if r not in in_b][:3]
    only_b = [r for r in b if r not in in_a][:3]
    return False, f"{len(a)} vs {len(b)} rows; {sorted(columns)}\n  spark {only_a}\n  sql   {only_b}", seconds


def session(partitions: int = 8):
    from pyspark.sql import SparkSession

    from facetloom.session import configure

    builder = (
        SparkSession.builder.master("local[8]").appName("facetloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = configure(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv):
    import __spark_entry__ as entry

    sf = "0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    folder = f"/root/testdata/sf{sf}"
    queries, oracles = entry.queries(), entry.oracle_sql()
    con, spark = connect(folder), session()
    bad = 0
    for name in argv or queries:
        try:
            ok, message, seconds = compare(spark, con, folder, name, queries, oracles)
        except Exception as error:  # keep going: this is a report
            ok, message, seconds = False, f"{type(error).__name__}: {str(error)[:1500]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {seconds:6.2f}s {message}", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
