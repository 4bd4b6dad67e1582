"""Compare registered queries with their SQL.  Usage: compare.py [sf] [names...]"""

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = []
    for row in rows:
        out.append(tuple("~" if row[i] is None else ("nan" if isinstance(row[i], float) and math.isnan(row[i]) else row[i]) for i in order))
    return sorted(out, key=repr)


def check(spark, con, name, query, sql, sf_dir):
    """None when both agree, otherwise what differs."""
    df = query(spark, sf_dir)
    spark_types = sorted((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    left = canonical([tuple(r) for r in df.collect()], df.columns)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    types = {"boolean": ("BOOLEAN",), "bigint": ("BIGINT",), "int": ("INTEGER",), "double": ("DOUBLE",), "string": ("VARCHAR",)}
    duck_types = {d[0]: str(d[1]) for d in rel.description}
    right = canonical(rel.fetchall(), names)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    wrong = [(n, t, duck_types[n]) for n, t in spark_types if duck_types[n] not in types.get(t, ()) and duck_types[n] not in ("NUMBER", "STRING")]
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    if left != right:
        bad = [(a, b) for a, b in zip(left, right) if a != b]
        return f"{len(bad)} of {len(left)} rows differ, first {bad[0]}"
    if wrong:
        return f"types {wrong}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    todo = sys.argv[2:] or list(queries())
    failed = []
    for name in todo:
        t = time.time()
        sql = oracle_sql().get(name)
        try:
            if sql is None:
                problem, note = None, f"rows only: {queries()[name](spark, sf_dir).count()}"
            else:
                problem, note = check(spark, con, name, queries()[name], sql, sf_dir), ""
        except Exception as error:  # noqa: BLE001
            problem, note = f"{type(error).__name__}: {str(error)[:1500]}", ""
        print(f"{'FAIL' if problem else 'ok  '} {name:28s} {time.time() - t:6.1f}s {note}{(problem or '')[:1500]}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
