"""Rules x records -> flags, per-record results and scores. One scan for all rules.

With many rules the generated code outgrows what the JVM compiles. The session setting of
``operators.session.split_large_methods`` makes Spark leave whole-stage code there for split methods.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecheck.functions import scalars as S
from tablecheck.functions.rules import Rule, predicate, rule_column
from tablecheck.operators.session import split_large_methods
from tablecheck.operators.skew import add_counts

# ---- fixed values -------------------------------------------------------------------
FAILED = "Rule condition not met"
ERROR = "Execution error"
# -------------------------------------------------------------------------------------


def _count_name(rule: Rule) -> str:
    return f"__n_{rule.id}"


def with_counts(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add the key-combination counts that cross-record rules test; others add nothing."""
    added: dict[tuple[str, ...], str] = {}
    for rule in rules:
        if not rule.needs_count or any(f not in df.columns for f in rule.target_fields):
            continue
        fields = tuple(rule.target_fields)
        if fields in added:
            df = df.withColumn(_count_name(rule), F.col(f"`{added[fields]}`"))
        else:
            df = add_counts(df, list(fields), _count_name(rule))
            added[fields] = _count_name(rule)
    return df


def _predicates(df: DataFrame, counted: DataFrame, rules: Sequence[Rule]) -> dict[str, Column]:
    out = {}
    for rule in rules:
        test = rule_column(df, rule)
        if _count_name(rule) in counted.columns:
            test = test & (F.coalesce(F.col(f"`{_count_name(rule)}`"), F.lit(0)) == 1)
        out[rule.id] = test
    return out


def _some(rules: Sequence[Rule]) -> Sequence[Rule]:
    if not rules:
        raise ValueError("no rules to evaluate")
    return rules


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def rule_flags(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The frame plus one boolean column per rule, named by rule id."""
    split_large_methods(df.sparkSession)
    counted = with_counts(df, _some(rules))
    flagged = counted.withColumns(_predicates(df, counted, rules))
    return flagged.select(*df.columns, *[F.col(f"`{r.id}`") for r in rules])


def evaluate(
    df: DataFrame,
    rules: Sequence[Rule],
    key: str,
    include_values: str = "all",
    evaluated_at: Column | None = None,
) -> DataFrame:
    """One row per (record, rule): passed, message and the record's values as text.

    ``include_values``: "all", "failed" (values only where the rule failed) or "none".
    """
    if include_values not in ("all", "failed", "none"):
        raise ValueError("include_values must be all, failed or none")
    at = evaluated_at if evaluated_at is not None else F.current_timestamp()
    split_large_methods(df.sparkSession)
    counted = with_counts(df, _some(rules))
    tests = _predicates(df, counted, rules)
    carried = [] if include_values == "none" else [S.field_values(df.columns).alias("__values")]
    rows = counted.select(
        F.col(f"`{key}`").alias("record_id"),
        *carried,
        F.posexplode(F.array(*[tests[r.id] for r in rules])).alias("__i", "passed"),
    )
    label = lambda texts: F.array(*[F.lit(t) for t in texts])[F.col("__i")]
    empty = F.lit(None).cast("map<string,string>")
    values = {
        "none": empty,
        "all": F.col("__values") if carried else empty,
        "failed": F.when(~F.col("passed"), F.col("__values")) if carried else empty,
    }[include_values]
    return rows.select(
        "record_id",
        label([r.id for r in rules]).alias("rule_id"),
        label([r.name for r in rules]).alias("rule_name"),
        "passed",
        F.when(F.col("passed"), "").otherwise(FAILED).alias("message"),
        values.alias("field_values"),
        at.alias("evaluated_at"),
    )


def rule_counts(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Per rule: rule_id, total, passed. Row rules share one scan and one aggregate;
    a uniqueness rule is one grouping by its key, without the join that per-row flags need."""
    split_large_methods(df.sparkSession)
    plain = [r for r in _some(rules) if not r.needs_count]
    parts = [_plain_counts(df, plain)] if plain else []
    parts += [_unique_counts(df, r) for r in rules if r.needs_count]
    return _union(parts)


def _plain_counts(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    one = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(predicate(df, r)).alias(f"p{i}") for i, r in enumerate(rules)],
    )
    unpivoted = F.array(
        *[
            F.struct(
                F.lit(r.id).alias("rule_id"), F.col("total").alias("total"), F.col(f"p{i}").alias("passed")
            )
            for i, r in enumerate(rules)
        ]
    )
    return one.select(F.inline(unpivoted))


def _unique_counts(df: DataFrame, rule: Rule) -> DataFrame:
    fields = [f for f in rule.target_fields if f in df.columns]
    groups = df.groupBy(*fields).agg(F.count(F.lit(1)).alias("__n"))
    ok = rule_column(groups, rule) & (F.col("__n") == 1)
    return groups.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("total"), F.count_if(ok).alias("passed")
    ).select(F.lit(rule.id).alias("rule_id"), "total", "passed")


def score_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Per rule: total, passed, failed and score (percentage passed, two digits)."""
    failed = F.col("total") - F.col("passed")
    return rule_counts(df, rules).select(
        "rule_id",
        "total",
        "passed",
        failed.alias("failed"),
        S.rate(F.col("passed"), F.col("total")).alias("score"),
    )


def quality_score(results: DataFrame, rules_submitted: int | None = None) -> DataFrame:
    """One-row run summary from per-record results; errors are counted apart from failures."""
    errored = F.col("message").startswith(ERROR)
    total, passed = F.col("total_evaluations"), F.col("passed")
    per_rule = results.groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("passed").alias("ok"),
        F.count_if(errored).alias("err"),
    )
    one = per_rule.agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("total_records"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_evaluations"),
        F.coalesce(F.sum("ok"), F.lit(0)).alias("passed"),
        F.coalesce(F.sum("err"), F.lit(0)).alias("errors"),
        F.count(F.lit(1)).alias("rules_executed"),
    )
    submitted = F.lit(rules_submitted).cast("bigint") if rules_submitted is not None else F.col("rules_executed")
    return one.select(
        "total_records",
        "total_evaluations",
        "passed",
        (total - passed - F.col("errors")).alias("failed"),
        "errors",
        submitted.alias("rules_submitted"),
        "rules_executed",
        S.rate(passed, total).alias("quality_score"),
    )


def pass_fail(df: DataFrame, passed: Column, by: list[str]) -> DataFrame:
    """Passed and failed counts per group; a null outcome counts as neither."""
    return df.groupBy(*by).agg(F.count_if(passed).alias("passed"), F.count_if(~passed).alias("failed"))


def python_rules(
    df: DataFrame,
    rules: Sequence[Rule],
    key: str,
    fields: Sequence[str] | None = None,
    include_values: str = "none",
) -> DataFrame:
    """Results of Python rules ``fn(record: dict) -> truthy``; exceptions become error results.

    Only ``key`` and ``fields`` (default: the rules' target fields, else every column) reach the
    rules. Values keep their types (a nullable whole number stays an int); missing values and NaN
    arrive as None, times without a zone, in the session's. With ``include_values`` "all" or
    "failed" the record's values as text are added as ``field_values``, errors included.
    """
    if include_values not in ("all", "failed", "none"):
        raise ValueError("include_values must be all, failed or none")
    named = list(dict.fromkeys(f for r in _some(rules) for f in r.target_fields))
    needed = list(fields) if fields is not None else (named or df.columns)
    calls = [(r.id, r.name, r.function) for r in rules]
    zone = ZoneInfo(df.sparkSession.conf.get("spark.sql.session.timeZone"))

    def plain(value: object) -> object:
        if isinstance(value, float) and value != value:
            return None
        if isinstance(value, datetime) and value.tzinfo is not None:
            return value.astimezone(zone).replace(tzinfo=None)
        return value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[plain(v) for v in batch.column(1 + i).to_pylist()] for i in range(len(needed))]
            records = [dict(zip(needed, row)) for row in zip(*columns)]
            carried = batch.columns[1 + len(needed) :]
            for rule_id, name, fn in calls:
                passed, message = [], []
                for record in records:
                    try:
                        ok = bool(fn(record))
                        text = "" if ok else FAILED
                    except Exception as e:  # the rule is user code: its error is a result
                        ok, text = False, f"{ERROR}: {e}"
                    passed.append(ok)
                    message.append(text)
                n = len(records)
                out = [batch.column(0), pa.array([rule_id] * n, pa.string()), pa.array([name] * n, pa.string())]
                out += [pa.array(passed, pa.bool_()), pa.array(message, pa.string()), *carried]
                yield pa.RecordBatch.from_arrays(out, names=[*result, *["field_values"] * len(carried)])

    result = ["record_id", "rule_id", "rule_name", "passed", "message"]
    key_type = df.schema[key].dataType.simpleString()
    schema = f"record_id {key_type}, rule_id string, rule_name string, passed boolean, message string"
    values = [] if include_values == "none" else [S.field_values(df.columns).alias("field_values")]
    read = [F.col(f"`{key}`").alias("0"), *[F.col(f"`{c}`").alias(str(i + 1)) for i, c in enumerate(needed)], *values]
    out = df.select(*read).mapInArrow(run, schema + ", field_values map<string,string>" * len(values))
    if include_values == "failed":
        out = out.withColumn("field_values", F.when(~F.col("passed"), F.col("field_values")))
    return out
