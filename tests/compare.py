"""Spark against DuckDB: same columns, same rows, any order. ``python tests/compare.py [NAME ...]`` prints what differs."""

import math
import sys
import time
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(fix(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


def difference(spark, name, run, sql, d):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    want = rows_of(columns, found.fetchall())
    df = run(spark, d)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    if got != want:
        a, b = set(map(str, got)), set(map(str, want))
        return f"rows {len(got)} and {len(want)}; only Spark {sorted(a - b)[:2]}; only SQL {sorted(b - a)[:2]}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.checkpoint.dir", "/tmp/compare").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or list(entry.oracle_sql())
    for n in names:
        t = time.time()
        try:
            out = difference(session, n, entry.queries()[n], entry.oracle_sql()[n], "/root/testdata/sf0.01")
        except Exception as e:
            out = f"{type(e).__name__} {str(e)[:600]}"
        print(n, "ok" if out is None else f"DIFFERS {out}", round(time.time() - t, 1), flush=True)
