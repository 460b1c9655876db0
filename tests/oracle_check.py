"""Run registered queries against their SQL: ``python tests/oracle_check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


def ordered(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    table = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(table, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, con, sf_dir, name, query, sql):
    """Differences as text, empty if the results are equal."""
    df = query(spark, sf_dir)
    left_names, left = ordered(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    right_names, right = ordered([d[0] for d in cur.description], cur.fetchall())
    if left_names != right_names:
        return f"columns {left_names} != {right_names}", len(left)
    if len(left) != len(right):
        only = set(left) ^ set(right)
        return f"rows {len(left)} != {len(right)}, e.g. {list(only)[:3]}", len(left)
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    kinds = {n: (type(a), type(b)) for n, a, b in zip(left_names, left[0], right[0]) if type(a) is not type(b)} if left else {}
    if bad:
        return f"{len(bad)} of {len(left)} rows differ, e.g. {bad[0]}", len(left)
    return (f"types differ {kinds}" if kinds else ""), len(left)


if __name__ == "__main__":
    import __spark_entry__ as entry
    from phasebeat.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    if os.environ.get("PLAIN_SESSION"):
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master("local[8]").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = local_session("8")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[2:] or list(queries)
    failed = []
    for name in wanted:
        start = time.time()
        try:
            found, rows = compare(spark, con, sf_dir, name, queries[name], oracles[name]) if name in oracles else ("no SQL", -1)
        except Exception as e:
            found, rows = f"{type(e).__name__}: {str(e)[:600]}", -1
            if "-v" in sys.argv:
                traceback.print_exc()
        print(f"{'ok  ' if not found else 'FAIL'} {name:28} {rows:7} rows {time.time() - start:6.2f}s {found[:900]}", flush=True)
        if found:
            failed.append(name)
    print("failed:", failed)
