"""Every catalogue query against DuckDB on the smallest tables, and the plans behind them."""

import os
import re
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as driver  # noqa: E402
from tablecheck.plans.queries import QUERIES  # noqa: E402
from tablecheck.plans.views import TABLES  # noqa: E402
from tools.compare import compare  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_duckdb(spark, con, name):
    result = compare(spark, con, name, SF)
    assert result.startswith(("ok", "rows")), result


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["rule_id", "total", "passed", "failed", "score"] and df.count() == 4


def test_every_statement_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rule_scan_is_single_and_pruned(spark):
    plan = plan_of(driver.queries()["q01_rule_score"](spark, SF))
    assert plan.count("FileScan parquet") == 1
    schema = re.search(r"ReadSchema: struct<(.*?)>", plan).group(1)
    assert "c_nationkey" not in schema
    assert plan.count("Exchange") == 1


def test_results_need_no_shuffle(spark):
    plan = plan_of(driver.queries()["q02_rule_results"](spark, SF))
    assert "Exchange" not in plan and plan.count("FileScan parquet") == 1


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"q41_autoencoder_score", "q40_pca_score", "q41b_network_score"}))
def test_no_single_task_window_or_cross_join(spark, name):
    plan = plan_of(driver.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Window [" in line:
            assert not any("Exchange SinglePartition" in below for below in lines[i + 1 : i + 4]), line


def test_filters_reach_the_scan(spark):
    for name, column in (("q28_audit_months", "o_orderdate"), ("q55_retention", "ts"), ("q29_keyset_page", "o_custkey")):
        plan = plan_of(driver.queries()[name](spark, SF))
        assert column in plan.split("PushedFilters: [")[1][:100], name


def test_table_and_column_conflicts_are_all_pairs_in_code_and_sql(spark, tmp_path):
    """A row for each pair, not for each group of rules that stands for many pairs."""
    name, columns = "q18_conflicts_table_column", ["rule_a", "rule_b", "a_scope", "b_scope", "parent_id", "pair_key"]
    parts = [(i, [7, 7, 7, 8, 9, None][i // 3 % 6], f"part {i}", "kind") for i in range(400)]
    spark.createDataFrame(parts, "p_partkey bigint, p_size int, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    sides = {
        scope: [
            (i, size, set() if i % 53 == 0 else {f"f{i % 7}"} | ({f"f{i % 5}"} if i % 2 else set()))
            for i, size, *_ in parts if i % 3 == rest and i % 5 and size is not None
        ]
        for scope, rest in (("table", 1), ("column", 2))
    }
    want = sorted(
        (a, b, "table", "column", size, "|".join(sorted((str(a), str(b)))))
        for a, size, x in sides["table"] for b, other, y in sides["column"] if size == other and (not x or not y or x & y)
    )
    found = driver.queries()[name](spark, str(tmp_path))
    assert found.columns == columns and sorted(map(tuple, found.collect())) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    stated = con.execute(driver.oracle_sql()[name])
    assert [c[0] for c in stated.description] == columns and sorted(stated.fetchall()) == want
    assert len(want) > driver.queries()["q18b_groups_table_column"](spark, str(tmp_path)).count()
