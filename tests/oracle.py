"""Run queries beside their DuckDB SQL: python tests/oracle.py [--sf DIR] [NAME...]"""

import datetime
import math
import os
import sys
import time
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(value(v) for v in x)
    if isinstance(x, dict):
        return tuple(sorted((k, value(v)) for k, v in x.items()))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def compare(spark, sf_dir, query, sql):
    """None if both give the same rows and column names, else what differs."""
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = Counter(tuple(value(r[c]) for c in cols) for r in df.collect())
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = Counter(tuple(value(r[i]) for i in at) for r in res.fetchall())
    if got != want:
        return f"{sum(got.values())} and {sum(want.values())} rows; only here {list((got - want).items())[:2]}; only there {list((want - got).items())[:2]}; columns {cols}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    args = sys.argv[1:]
    sf = args[args.index("--sf") + 1] if "--sf" in args else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("-") and a != sf] or [n for n in e.queries() if n in e.oracle_sql()]
    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("OFF")
    queries, oracles = e.queries(), e.oracle_sql()
    for n in names:
        began = time.time()
        try:
            bad = compare(s, sf, queries[n], oracles[n])
        except Exception as x:  # noqa: BLE001
            bad = f"{type(x).__name__}: {str(x)[:700]}"
        print(f"{'ok ' if not bad else 'BAD'} {n} {time.time() - began:.1f}s {bad or ''}", flush=True)
