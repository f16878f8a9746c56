"""Inputs that once gave wrong answers or aborted."""

import os
import re
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablecheck import Rule
from tablecheck.functions.rules import condition_column
from tablecheck.operators import clean, diff, profile, quantile, rows, session
from tablecheck.operators import evaluate as ev
from tablecheck.operators.autoencoder import train_autoencoder
from tablecheck.plans import jobs
from tablecheck.sources import readers, writers

BIG = 2**53 + 1


@pytest.mark.parametrize("kind", ["bigint", "decimal(38,0)", "string"])
@pytest.mark.parametrize("as_text", [False, True])
def test_whole_numbers_past_2_to_53(spark, kind, as_text):
    df = spark.createDataFrame([(BIG - 1,), (BIG,), (BIG + 1,)], "v bigint").select(F.col("v").cast(kind).alias("v"))
    bound = str(BIG) if as_text else BIG

    def holds(operator, value=bound):
        test = condition_column(df, {"field": "v", "operator": operator, "value": value})
        return [r["t"] for r in df.select("v", test.alias("t")).orderBy(F.col("v").cast("bigint")).collect()]

    assert holds("equals") == [False, True, False]
    assert holds("not_equals") == [True, False, True]
    assert holds("greater_than") == [False, False, True]
    assert holds("less_than") == [True, False, False]
    assert holds("between", f"{BIG},{BIG}") == [False, True, False]


def test_numbers_of_every_kind_keep_their_meaning(spark):
    df = spark.createDataFrame(
        [(1, 0.1, Decimal("0.10"), "1e300", "-7"), (None, None, None, "x", str(BIG))], "i int, d double, c decimal(10,2), t string, u string"
    )

    def holds(field, operator, value):
        test = condition_column(df, {"field": field, "operator": operator, "value": value})
        return df.select(F.coalesce(test, F.lit(False)).alias("t")).first()["t"]

    assert holds("i", "equals", 1.0) and holds("i", "equals", "1") and not holds("i", "equals", 1.5) and holds("i", "less_than", "1.5")
    assert holds("d", "equals", "0.1") and holds("d", "equals", 0.1) and holds("c", "equals", "0.1") and holds("c", "greater_than", "0.099999999999999999999")
    assert holds("t", "greater_than", str(BIG)) and not holds("t", "less_than", str(BIG)) and holds("u", "less_than", BIG)
    assert holds("i", "less_than", 10**30) and holds("i", "greater_than", "-inf") and not holds("i", "equals", "one")


def test_python_rules_see_exact_values(spark):
    df = spark.createDataFrame(
        [(1, BIG, 1.5, datetime(2024, 1, 2, 3)), (2, None, float("nan"), None)], "id bigint, n bigint, x double, at timestamp"
    ).repartition(1)
    seen = ev.python_rules(
        df, [Rule("r", function=lambda r: r["n"] == BIG and r["x"] == 1.5 and r["at"] == datetime(2024, 1, 2, 3)),
             Rule("s", function=lambda r: 1 // 0)], "id", ["n", "x", "at"], include_values="all")
    got = {(r.record_id, r.rule_id): r for r in seen.collect()}
    assert got[1, "r"].passed and not got[2, "r"].passed and got[2, "s"].message.startswith("Execution error")
    assert got[1, "s"].field_values["n"] == str(BIG) and got[2, "r"].field_values.keys() == {"id", "n", "x", "at"}
    nulls = ev.python_rules(df, [Rule("r", function=lambda r: r["n"] is None and r["x"] is None)], "id", ["n", "x"], include_values="failed")
    assert {r.record_id: (r.passed, r.field_values is None) for r in nulls.collect()} == {1: (False, False), 2: (True, True)}


def test_run_ids_that_look_alike(spark, tmp_path):
    people = f"{tmp_path}/people.parquet"
    spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, name string").write.parquet(people)
    rule = [Rule("r1", target_fields=("name",)), Rule("r2", target_fields=("name",), function=lambda r: r["name"])]
    out, ledger = f"{tmp_path}/results", f"{tmp_path}/ledger"
    first = jobs.validation_job(spark, "1", people, rule[:1], "id", out, ledger)
    again = jobs.validation_job(spark, "01", people, rule, "id", out, ledger)
    assert (first["summary"]["total_evaluations"], again["summary"]["total_evaluations"]) == (3, 6)
    rows_ = writers.read_run(spark, out, spark.read.parquet(out), "run_id", "01").collect()
    assert len(rows_) == 6 and all(r.field_values for r in rows_)


def test_failed_cleaning_can_run_again(spark, tmp_path):
    source, backup = f"{tmp_path}/s.parquet", f"{tmp_path}/backup.parquet"
    spark.createDataFrame([(1, "a"), (2, None)], "id int, name string").write.parquet(source)

    def broken(df):
        raise RuntimeError("x" * 5000)

    args = (spark, "j", source)
    with pytest.raises(RuntimeError):
        jobs.clean_job(*args, [broken], ["id"], backup, f"{tmp_path}/out", f"{tmp_path}/ledger")
    assert len(jobs.job_status(spark.read.parquet(f"{tmp_path}/ledger"), "j").first()["error_message"]) == 5000
    done = jobs.clean_job(*args, clean.compile_steps([("fill_nulls", {"column": "name"})]), ["id"], backup, f"{tmp_path}/out", f"{tmp_path}/ledger")
    assert done["summary"]["modified_records"] == 1 and spark.read.parquet(backup).where("name is null").count() == 1
    with pytest.raises(ValueError):
        writers.snapshot(spark, source, backup, "other")
    os.remove(f"{backup}/_SUCCESS")  # as if the copy had broken off
    writers.snapshot(spark, source, backup, "j")
    assert spark.read.parquet(backup).count() == 2


def test_state_of_a_run_that_started_again(spark):
    day = [datetime(2024, 1, d) for d in range(1, 4)]
    ledger = spark.createDataFrame(
        [("a", "running", day[0], None), ("a", "completed", day[0], day[1]), ("a", "running", day[2], None)],
        "id string, status string, started_at timestamp, completed_at timestamp")
    assert jobs.current_state(ledger).first()["status"] == "running"


def test_filling_numbers_and_dates(spark):
    df = spark.createDataFrame([(None, None, None), (1, None, "x")], "n bigint, d date, t string")
    steps = clean.plan_steps(
        ["missing values in n", "missing values in d", "missing values in t"], {"n": {"value": "5"}, "d": {"value": "2024-02-03"}})
    done = clean.clean(df, clean.compile_steps(steps))
    assert done.dtypes == df.dtypes and [tuple(map(str, r)) for r in done.collect()] == [("5", "2024-02-03", "Unknown"), ("1", "2024-02-03", "x")]
    with pytest.raises(ValueError):
        clean.clean(df, clean.compile_steps(clean.plan_steps(["missing values in n"])))


def test_diff_of_different_types_and_null_keys(spark):
    before = spark.createDataFrame([(1, 5), (2, 6), (None, 7)], "k int, v bigint")
    after = spark.createDataFrame([(1, "5"), (2, "six"), (None, "7")], "k int, v string")
    got = {r.k: (r.change, r.changed_columns) for r in diff.row_diff(before, after, ["k"]).collect()}
    assert got == {1: ("unchanged", []), 2: ("modified", ["v"]), None: ("unchanged", [])}


def test_nothing_to_evaluate_or_train(spark):
    df = spark.createDataFrame([], "id int, x double")
    for f in (lambda: ev.evaluate(df, [], "id"), lambda: ev.score_rules(df, []), lambda: ev.rule_flags(df, []), lambda: ev.python_rules(df, [], "id")):
        with pytest.raises(ValueError, match="no rules"):
            f()
    with pytest.raises(ValueError):
        train_autoencoder(df, order=["id"], columns=["x"], epochs=1)


def test_preview_looks_at_all_rows_it_was_asked_for(spark, tmp_path):
    path = f"{tmp_path}/x.csv"
    with open(path, "w") as f:
        f.write("c\n" + "1\n" * 100 + "abc\n" * 100)
    assert profile.preview_csv(spark, path, n=200)["column_types"] == {"c": "string"}
    assert profile.preview_csv(spark, path, n=100)["column_types"] == {"c": "boolean"}


def test_two_hundred_rules_scan_the_file_once(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    spark.range(50).select("id", (F.col("id") * 2).alias("n")).write.parquet(path)
    df = readers.read_dataset(spark, path)
    rules = [Rule(f"r{i}", conditions=({"field": "n", "operator": "greater_than", "value": i},)) for i in range(200)]
    for out in (ev.evaluate(df, rules, "id", "none"), ev.score_rules(df, rules), ev.rule_flags(df, rules)):
        assert len(re.findall("FileScan parquet", out._jdf.queryExecution().executedPlan().toString())) == 1
    assert {r.rule_id: r.passed for r in ev.score_rules(df, rules).collect()} == {f"r{i}": sum(2 * k > i for k in range(50)) for i in range(200)}
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == session.COMPILED_BYTES


def test_searched_and_sorted_ranks_agree(spark, monkeypatch):
    data = [(k % 7 if k % 5 else None, float("nan") if k % 11 == 0 else k / 3) for k in range(200)]
    df = spark.createDataFrame(data, "a int, b double")
    found = {}
    for sortable in (quantile.SORTABLE, 0):
        monkeypatch.setattr(quantile, "SORTABLE", sortable)
        parts = [rows.rows_from(df, ["a", "b"], k) for k in (3, 41, 100, 199)]
        found[sortable] = [quantile.exact_percentile(df, "b", p) for p in (10, 50, 99)]
        found[sortable] += [None if x is None else sorted(map(repr, x.collect())) for x in parts]
    assert len({repr(v) for v in found.values()}) == 1
