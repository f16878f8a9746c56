"""Run catalogue queries and their DuckDB statements side by side.

    python tools/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablecheck.plans.oracles import ORACLES  # noqa: E402
from tablecheck.plans.queries import QUERIES  # noqa: E402
from tablecheck.plans.views import TABLES  # noqa: E402


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def rows_of(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in records), key=repr)


def compare(spark, con, name: str, sf_dir: str) -> str:
    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    got, names = [tuple(r) for r in df.collect()], df.columns
    took = time.time() - start
    if name not in ORACLES:
        return f"rows  {name}: {len(got)} rows, {took:.1f}s"
    cur = con.execute(ORACLES[name])
    want_names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(want_names):
        return f"FAIL  {name}: columns {sorted(names)} vs {sorted(want_names)}"
    a, b = rows_of(got, names), rows_of(want, want_names)
    if a == b:
        return f"ok    {name}: {len(a)} rows, {took:.1f}s"
    sa, sb = set(a), set(b)
    return (
        f"FAIL  {name}: {len(a)} vs {len(b)} rows, columns {sorted(names)}\n"
        f"   only spark: {sorted(sa - sb, key=repr)[:3]}\n   only duckdb: {sorted(sb - sa, key=repr)[:3]}"
    )


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        try:
            print(compare(spark, con, name, sf_dir), flush=True)
        except Exception as e:
            print(f"ERROR {name}: {type(e).__name__} {str(e)[:600]}", flush=True)


if __name__ == "__main__":
    main()
