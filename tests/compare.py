"""Runs registered queries next to their SQL and reports differences.

``python tests/compare.py [sf] [name-prefix ...]``
"""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canon(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value)
    if isinstance(value, Decimal):
        return "dec:" + str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canon(v) for v in value) + "]"
    return f"{type(value).__name__}:{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sf_dir: str) -> str | None:
    df = query.run(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if query.sql is None:
        return None
    cur = con.execute(query.sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    left, right = rows_of(df.columns, got), rows_of(names, want)
    if left == right:
        return None if left else "EMPTY"
    has_left, has_right = set(left), set(right)
    extra = [r for r in left if r not in has_right][:3]
    lost = [r for r in right if r not in has_left][:3]
    return f"rows {len(left)} != {len(right)}\n   spark-only {extra}\n   sql-only   {lost}"


def main(argv):
    sf = argv[0] if argv else "sf0.001"
    prefixes = tuple(argv[1:])
    from tidewright.catalogue import QUERIES
    from tidewright.session import build_session

    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/{sf}"
    con = connect(sf_dir)
    bad = 0
    for query in QUERIES.values():
        if prefixes and not query.name.startswith(prefixes):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, query, sf_dir)
        except Exception as exc:  # report and go on to the next query
            problem = f"{type(exc).__name__}: {str(exc)[:900]}"
        took = time.time() - start
        if problem:
            bad += 1
            print(f"FAIL {query.name} {took:.1f}s {problem}", flush=True)
        else:
            print(f"ok   {query.name} {took:.1f}s{'' if query.sql else ' (rows only)'}", flush=True)
    print("failures", bad)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
