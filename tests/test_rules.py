import math
from datetime import date, datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablecheck import Rule
from tablecheck.functions.rules import CATEGORIES, rule_column
from tablecheck.operators import evaluate as ev

DDL = "id int, name string, age double, day string, seen date, flag boolean, n int"
ROWS = [
    (1, "Ann", 31.0, "2024-01-05", date(2024, 1, 5), True, 5),
    (2, " \t", float("nan"), "2024-02-30", None, False, 7),
    (3, None, None, None, date(2024, 1, 6), None, None),
    (4, "Bob", 2e6, "yesterday", date(2023, 1, 1), True, 5),
    (5, " ", -5.0, "2024-01-05T10:00:00Z", date(2024, 5, 5), False, 9),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, DDL).cache()


def passing(df, rule):
    return {r["id"] for r in df.where(rule_column(df, rule)).collect()}


@pytest.mark.parametrize(
    "category,fields,parameters,ids",
    [
        ("simple", ("name",), {}, {1, 4}),
        ("simple", ("age",), {}, {1, 4, 5}),
        ("cross_field", ("name", "age"), {}, {1, 4, 5}),
        ("statistical_outlier", ("age",), {}, {1, 5}),
        ("statistical_outlier", ("age",), {"lo": "0", "hi": "31"}, {1}),
        ("statistical_outlier", ("day",), {}, set()),
        ("statistical_outlier", ("seen",), {}, set()),
        ("multi_record", ("n",), {}, {1, 2, 4, 5}),
        ("temporal", ("day",), {}, {1, 5}),
        ("temporal", ("seen",), {}, {1, 3, 4, 5}),
        ("pattern", ("name",), {}, {1, 4}),
        ("pattern", ("name",), {"regex": "^A"}, {1}),
        ("pattern", ("age",), {}, set()),
        ("no_such_category", ("name",), {}, {1, 4}),
        ("simple", ("no_such_column",), {}, set()),
        ("simple", (), {}, {1, 2, 3, 4, 5}),
    ],
)
def test_templates(df, category, fields, parameters, ids):
    assert passing(df, Rule("r", category=category, target_fields=fields, parameters=parameters)) == ids


@pytest.mark.parametrize(
    "condition,ids",
    [
        ({"field": "name", "operator": "equals", "value": "Ann"}, {1}),
        ({"field": "name", "operator": "not_equals", "value": "Ann"}, {2, 4, 5}),
        ({"field": "age", "operator": "greater_than", "value": "0"}, {1, 4}),
        ({"field": "age", "operator": "less_than", "value": 0}, {5}),
        ({"field": "age", "operator": "between", "value": "0 AND 150"}, {1}),
        ({"field": "age", "operator": "between", "value": [-5, 31]}, {1, 5}),
        ({"field": "name", "operator": "contains", "value": "n"}, {1}),
        ({"field": "name", "operator": "not_null"}, {1, 2, 4, 5}),
        ({"field": "age", "operator": "not_null"}, {1, 4, 5}),
        ({"field": "name", "operator": "regex", "value": "^[A-Z][a-z]+$"}, {1, 4}),
        ({"field": "name", "operator": "matches", "value": "o"}, {4}),
        ({"field": "flag", "operator": "equals", "value": "true"}, {1, 4}),
        ({"field": "seen", "operator": "greater_than", "value": "2024-01-05"}, {3, 5}),
        ({"field": "n", "operator": "equals", "value": "5"}, {1, 4}),
        ({"field": "n", "operator": "greater_than", "value": "5.5"}, {2, 5}),
        ({"field": "n", "operator": "equals", "value": "five"}, set()),
        ({"field": "age", "operator": "greater_than", "other_field": "n"}, {1, 4}),
        ({"field": "gone", "operator": "not_null"}, set()),
    ],
)
def test_conditions(df, condition, ids):
    assert passing(df, Rule("r", conditions=(condition,))) == ids


def test_combination_runs_left_to_right(df):
    a = {"field": "name", "operator": "equals", "value": "Ann"}
    b = {"field": "age", "operator": "less_than", "value": "0", "logicalOperator": "OR"}
    c = {"field": "n", "operator": "equals", "value": "9", "logicalOperator": "AND"}
    assert passing(df, Rule("r", conditions=(a, b, c))) == {5}
    assert passing(df, Rule("r", conditions=(a, {**b, "logicalOperator": None}))) == set()


@pytest.mark.parametrize(
    "condition",
    [
        {"field": "name", "operator": "sounds_like", "value": "x"},
        {"field": "age", "operator": "between", "value": "1"},
        {"field": "name", "operator": "contains", "other_field": "day"},
    ],
)
def test_bad_rules_fail_when_built(df, condition):
    with pytest.raises(ValueError):
        rule_column(df, Rule("r", conditions=(condition,)))


def test_bad_regex_fails_when_built(df):
    with pytest.raises(Exception, match="(?i)unclosed|pattern"):
        rule_column(df, Rule("r", conditions=({"field": "name", "operator": "regex", "value": "["},)))


# ---- a plain Python statement of each template, compared on generated rows -----------


def _missing(v):
    return v is None or (isinstance(v, float) and math.isnan(v))


def _number(v):
    if _missing(v):
        return None
    try:
        n = float(str(v).strip().replace("_", "?"))
    except ValueError:
        return None
    return None if math.isnan(n) else n


def _iso(v):
    try:
        datetime.fromisoformat(v.replace("Z", "+00:00"))
    except ValueError:
        return False
    return True


STATED = {
    "simple": lambda v: not _missing(v) and not (isinstance(v, str) and not v.strip()),
    "cross_field": lambda v: not _missing(v),
    "multi_record": lambda v: not _missing(v),
    "statistical_outlier": lambda v: _number(v) is not None and -1e6 <= _number(v) <= 1e6,
    "pattern": lambda v: isinstance(v, str) and bool(v.strip()),
    "temporal": lambda v: not _missing(v) and (not isinstance(v, str) or _iso(v)),
}

TEXTS = st.one_of(
    st.none(),
    st.sampled_from(["", " ", "\t", " ", "　x", "0", " 5 ", "+7", "1e5", "1e7", "nan", "inf", "1d", "0x1", "1_000",
                     "2024-01-05", "2024-02-30", "2024-01-05T10:00:00", "2024-01-05T10:00:00Z", "2024-13-01", "True"]),
    st.text(alphabet="ab 0159.-+eE\t ", max_size=6),
)
NUMBERS = st.one_of(st.none(), st.floats(allow_nan=True, allow_infinity=True), st.integers(-2_000_000, 2_000_000).map(float))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(TEXTS, min_size=30, max_size=60), numbers=st.lists(NUMBERS, min_size=30, max_size=60))
def test_templates_match_plain_python(spark, texts, numbers):
    n = min(len(texts), len(numbers))
    rows = list(zip(range(n), texts, numbers))
    df = spark.createDataFrame(rows, "id int, t string, d double")
    rules = [Rule(f"{c}_{f}", category=c, target_fields=(f,)) for c in CATEGORIES for f in ("t", "d")]
    for got in ev.rule_flags(df, rules).collect():
        for rule in rules:
            value = got[rule.target_fields[0]]
            assert got[rule.id] == STATED[rule.category](value), (rule.id, value)


# ---- evaluation ---------------------------------------------------------------------


def test_evaluate_results(df):
    rules = [Rule("named", "has name", "simple", ("name",)), Rule("num", "n", "cross_field", ("n",))]
    out = {(r["record_id"], r["rule_id"]): r for r in ev.evaluate(df, rules, "id", evaluated_at=F.lit(datetime(2024, 1, 1))).collect()}
    assert len(out) == 10
    assert out[1, "named"]["passed"] and out[1, "named"]["message"] == ""
    bad = out[3, "named"]
    assert (bad["passed"], bad["message"], bad["rule_name"]) == (False, "Rule condition not met", "has name")
    assert bad["field_values"]["id"] == "3" and bad["field_values"]["name"] is None
    failed = ev.evaluate(df, rules, "id", "failed").collect()
    assert all((r["field_values"] is None) == r["passed"] for r in failed)
    assert all(r["field_values"] is None for r in ev.evaluate(df, rules, "id", "none").collect())
    with pytest.raises(ValueError):
        ev.evaluate(df, rules, "id", "some")


def test_unique_rule_with_hot_and_null_keys(spark):
    rows = [(i, 0 if i % 3 else i, None if i % 10 == 0 else "k") for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, a int, b string").repartition(4)
    rule = Rule("u", category="multi_record", target_fields=("a", "b"), parameters={"unique": "true"})
    expected = {i for i, a, b in rows if b is not None and a != 0}
    assert {r["id"] for r in ev.rule_flags(df, [rule]).where("u").collect()} == expected
    assert {r["record_id"] for r in ev.evaluate(df, [rule], "id", "none").where("passed").collect()} == expected
    score = ev.score_rules(df, [rule, Rule("p", category="cross_field", target_fields=("b",))]).collect()
    by = {r["rule_id"]: r for r in score}
    assert (by["u"]["total"], by["u"]["passed"]) == (3000, len(expected))
    assert (by["p"]["total"], by["p"]["passed"]) == (3000, 2700)


def test_many_rules_are_evaluated_in_one_scan(df):
    fields = ["n", "id"]
    rules = [Rule(f"r{i}", f"rule {i}", conditions=({"field": fields[i % 2], "operator": "greater_than", "value": i},)) for i in range(120)]
    at = {"n": 6, "id": 0}
    expected = {f"r{i}": sum(1 for row in ROWS if (row[at[fields[i % 2]]] or 0) > i) for i in range(120)}
    assert {r["rule_id"]: r["passed"] for r in ev.score_rules(df, rules).collect()} == expected
    results = ev.evaluate(df, rules, "id", "none").where("passed").groupBy("rule_id", "rule_name").count().collect()
    assert {r["rule_id"]: r["count"] for r in results} == {k: v for k, v in expected.items() if v}
    assert all(r["rule_name"] == f"rule {r['rule_id'][1:]}" for r in results)


def test_python_rule_counts_errors_apart(df):
    def adult(record):
        if record["age"] is None:
            raise KeyError("age")
        return record["age"] > 18

    rule = Rule("adult", "adult", target_fields=("age",), function=adult)
    results = ev.python_rules(df, [rule], "id")
    got = {r["record_id"]: (r["passed"], r["message"]) for r in results.collect()}
    assert got[1] == (True, "") and got[5] == (False, "Rule condition not met")
    assert got[3][0] is False and got[3][1].startswith("Execution error")
    summary = ev.quality_score(results, rules_submitted=2).first()
    assert (summary["total_evaluations"], summary["passed"], summary["failed"], summary["errors"]) == (5, 2, 1, 2)
    assert (summary["quality_score"], summary["rules_submitted"], summary["rules_executed"]) == (40.0, 2, 1)
    with pytest.raises(ValueError):
        rule_column(df, rule)


def test_score_of_nothing(spark):
    empty = spark.createDataFrame([], "record_id int, rule_id string, passed boolean, message string")
    one = ev.quality_score(empty).first()
    assert (one["total_evaluations"], one["quality_score"]) == (0, 0.0)


def test_rules_work_on_a_stream(spark, df, tmp_path):
    source, name = str(tmp_path / "in"), "flagged_stream"
    df.write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    flagged = ev.evaluate(stream, [Rule("named", target_fields=("name",))], "id", "none")
    q = flagged.writeStream.format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
        assert {r["record_id"] for r in spark.table(name).where("passed").collect()} == {1, 4}
    finally:
        q.stop()
