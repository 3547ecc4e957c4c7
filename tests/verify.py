"""python tests/verify.py [SF_DIR] [NAME...]: each query beside its SQL in DuckDB."""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, decimal.Decimal):
        return float(x)
    if hasattr(x, "asDict"):
        return tuple(sorted((k, cell(v)) for k, v in x.asDict().items()))
    if isinstance(x, dict):
        return tuple(sorted((k, cell(v)) for k, v in x.items()))
    if isinstance(x, (list, tuple)):
        return tuple(map(cell, x))
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    return float(f"{x:.10g}") if isinstance(x, float) else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(cell(r[k]) for k in order) for r in rows), key=repr)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def compare(spark, con, name, query, sql, sf_dir):
    began = time.time()
    frame = query(spark, sf_dir)
    mine = rows_of(frame.columns, frame.collect())
    took = time.time() - began
    if sql is None:
        return f"rows only: {len(mine[1])}", took, True
    result = con.execute(sql)
    other = rows_of([d[0] for d in result.description], result.fetchall())
    if mine == other:
        return f"equal: {len(mine[1])} rows", took, True
    if mine[0] != other[0]:
        return f"COLUMNS {mine[0]} {other[0]}", took, False
    odd = next(((a, b) for a, b in zip(mine[1], other[1]) if a != b), None)
    return f"DIFFERENT {len(mine[1])} {len(other[1])} {str(odd)[:600]}", took, False


def session(cores=8):
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = session(), duck(sf_dir)
    queries, oracles, bad = entry.queries(), entry.oracle_sql(), []
    for name in sys.argv[2:] or queries:
        try:
            said, took, good = compare(spark, con, name, queries[name], oracles.get(name), sf_dir)
        except Exception as e:
            said, took, good = f"ERROR {str(e)[:1500]}", 0, False
        print(f"{name}: {said} ({took:.1f} s)", flush=True)
        if not good:
            bad.append(name)
    print("bad:", bad)
