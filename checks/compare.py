"""Run queries and their SQL side by side: schema, row count and values.

Usage: python -m checks.compare [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from checks import oracle
from checks.queries import QUERIES
from traceloom.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf_dir: str, name: str) -> list[str]:
    """Differences between the query and its SQL; empty if there are none."""
    df = QUERIES[name](spark, sf_dir)
    got_columns = sorted(df.columns)
    got_types = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    got = Counter(tuple(plain(r[c]) for c in got_columns) for r in df.collect())
    cursor = con.execute(oracle.oracle_sql()[name])
    want_types = {d[0]: str(d[1]) for d in cursor.description}
    names = [d[0] for d in cursor.description]
    rows = cursor.fetchall()
    problems = []
    if sorted(names) != got_columns:
        return [f"columns differ: {sorted(set(names) ^ set(got_columns))}"]
    different = {c: (got_types[c], want_types[c]) for c in got_columns if got_types[c] != want_types[c]}
    if different:
        problems.append(f"types differ: {different}")
    at = [names.index(c) for c in got_columns]
    want = Counter(tuple(plain(r[i]) for i in at) for r in rows)
    if got != want:
        extra, missing = got - want, want - got
        problems.append(f"rows {sum(got.values())} / {sum(want.values())}, columns {got_columns}")
        problems += [f"  only ours   {r}" for r in sorted(extra, key=repr)[:3]]
        problems += [f"  only theirs {r}" for r in sorted(missing, key=repr)[:3]]
    elif not rows:
        problems.append("no rows")
    return problems


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    options = parser.parse_args()
    spark = build_session(
        "compare",
        master="local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(options.sf)
    failed = 0
    for name in options.names or QUERIES:
        started = time.time()
        try:
            problems = compare(spark, con, options.sf, name)
        except Exception as error:  # report and go on with the next query
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {time.time() - started:6.2f}s {name}", flush=True)
        for problem in problems:
            print(f"       {problem}", flush=True)
    print(f"{failed} of {len(options.names or QUERIES)} differ")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
