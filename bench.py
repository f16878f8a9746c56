"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is run to the end (all rows produced, none collected). With BENCH_DUCKDB set, DuckDB runs the
same statements for comparison; with BENCH_PANDAS set,
the single-process alternative for rule scoring is timed too: one Python call per rule and record.
"""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time

import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablecheck.plans.oracles import ORACLES  # noqa: E402
from tablecheck.plans.queries import QUERIES  # noqa: E402
from tablecheck.plans.views import TABLES  # noqa: E402

HEADLINE = [
    "q01_rule_score", "q02_rule_results", "q06_unique", "q08_pattern", "q11_infer_types", "q12_schema_check",
    "q13_run_metrics", "q14_dataset_ranking", "q16_period_change", "q17_conflicts_catalog_table",
    "q20_with_resolutions", "q22_expand_rules", "q23_row_diff", "q25_dedup_clean", "q28_audit_months",
    "q29_keyset_page", "q33_versions", "q34_latest_state", "q35_scaler", "q36_threshold", "q37_severity",
    "q38_anomaly_summary", "q40_pca_score", "q41_autoencoder_score", "q43_split_ordered", "q44_row_index",
    "q52d_lint_training", "q54_rule_text_parse", "q56_python_rule", "q60_upsert",
]


def pandas_loop(sf_dir: str) -> float:
    """Four rules over lineitem, one call per rule and record, in one process."""
    rules = [
        lambda r: r["l_quantity"] is not None,
        lambda r: 0 <= r["l_discount"] <= 0.1,
        lambda r: r["l_extendedprice"] > 1000,
        lambda r: r["l_returnflag"] in ("A", "N", "R"),
    ]
    start = time.time()
    df = pd.read_parquet(f"{sf_dir}/lineitem.parquet")
    passed = 0
    for rule in rules:
        for _, row in df.iterrows():
            passed += bool(rule(row.to_dict()))
    return time.time() - start


def duckdb_times(sf_dir: str, names: list[str], cpus: int) -> dict[str, float]:
    """Seconds that one DuckDB process takes for the same results, where SQL states them."""
    import duckdb

    con = duckdb.connect(config={"threads": cpus})
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    out = {}
    for name in (n for n in names if n in ORACLES):
        start = time.time()
        con.execute(f"CREATE OR REPLACE TEMP TABLE result AS {ORACLES[name]}")
        out[name] = round(time.time() - start, 3)
    return out


def spark_loop(spark: SparkSession, sf_dir: str) -> float:
    """The same four rules as Columns."""
    from tablecheck import Rule
    from tablecheck.operators.evaluate import score_rules

    start = time.time()
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rules = [
        Rule("quantity", conditions=({"field": "l_quantity", "operator": "not_null"},)),
        Rule("discount", conditions=({"field": "l_discount", "operator": "between", "value": "0,0.1"},)),
        Rule("price", conditions=({"field": "l_extendedprice", "operator": "greater_than", "value": 1000},)),
        Rule("flag", conditions=({"field": "l_returnflag", "operator": "regex", "value": "^[ANR]$"},)),
    ]
    score_rules(df, rules).collect()
    return time.time() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("tablecheck-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().collect()  # warm-up
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        with contextlib.redirect_stdout(sys.stderr):
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    extra = {"duckdb": duckdb_times(sf_dir, list(times), int(cpus))} if os.environ.get("BENCH_DUCKDB") else {}
    if not sys.argv[1:]:
        extra |= {"lineitem_rules_spark": round(spark_loop(spark, sf_dir), 3)}
        if os.environ.get("BENCH_PANDAS"):  # minutes at sf0.1
            extra["lineitem_rules_pandas_loop"] = round(pandas_loop(sf_dir), 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0), **extra,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
