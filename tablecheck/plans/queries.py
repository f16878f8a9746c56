"""The query catalogue: one DataFrame per operator over the benchmark tables, whole tables only.

The matching DuckDB statements are in ``oracles.py``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.functions import ruletext
from tablecheck.functions import scalars as S
from tablecheck.functions.rules import Rule
from tablecheck.operators import audit as audit_ops
from tablecheck.operators import catalog, clean, conflicts, lint, listing, metrics, notify, profile, reports
from tablecheck.operators import evaluate as ev
from tablecheck.operators.autoencoder import anomaly_summary, classify, reconstruction_error, scorable, train_autoencoder
from tablecheck.operators.diff import cleaning_summary, row_diff
from tablecheck.operators.model import Model, init_weights, layer_sizes
from tablecheck.operators.pca import train_pca
from tablecheck.operators.quantile import exact_percentile
from tablecheck.operators.retention import purge_expired
from tablecheck.operators.rows import split_ordered, with_row_index
from tablecheck.operators.scale import scaled, scaler_stats
from tablecheck.operators.state import delete_keys, latest_per_key, update_columns, upsert
from tablecheck.plans.views import table
from tablecheck.sources.readers import check_files
from tablecheck.sources.writers import anomaly_fields, export_long, export_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---- rules --------------------------------------------------------------------------

CUSTOMER_RULES = [
    Rule("name_present", "name present", conditions=({"field": "c_name", "operator": "not_null"},)),
    Rule(
        "name_format", "name format",
        conditions=({"field": "c_name", "operator": "regex", "value": "^Customer#[0-9]{9}$"},),
    ),
    Rule(
        "balance_range", "balance range",
        conditions=({"field": "c_acctbal", "operator": "between", "value": "0,9000"},),
    ),
    Rule("complete", "complete", "simple", ("c_name", "c_acctbal", "c_mktsegment")),
]


@query
def q01_rule_score(spark, d):
    return ev.score_rules(table(spark, d, "customer_dirty"), CUSTOMER_RULES)


@query
def q01b_run_summary(spark, d):
    results = ev.evaluate(table(spark, d, "customer_dirty"), CUSTOMER_RULES, "c_custkey", "none")
    return ev.quality_score(results, rules_submitted=len(CUSTOMER_RULES))


@query
def q02_rule_results(spark, d):
    results = ev.evaluate(table(spark, d, "customer_dirty"), CUSTOMER_RULES, "c_custkey")
    value = lambda c: F.element_at("field_values", c)
    return results.select(
        "record_id", "rule_id", "rule_name", "passed", "message",
        value("c_name").alias("v_name"), value("c_mktsegment").alias("v_segment"), value("c_nationkey").alias("v_nation"),
    )


def _flags(spark, d, name: str, key: str, rules: list[Rule]) -> DataFrame:
    return ev.rule_flags(table(spark, d, name), rules).select(key, *[r.id for r in rules])


@query
def q03_simple(spark, d):
    return _flags(spark, d, "customer_dirty", "c_custkey", [Rule("ok", "", "simple", ("c_name", "c_mktsegment"))])


@query
def q04_cross_field(spark, d):
    rules = [
        Rule("both", "", "cross_field", ("c_name", "c_acctbal")),
        Rule(
            "above", "", "cross_field",
            conditions=({"field": "c_acctbal", "operator": "greater_than", "other_field": "c_custkey"},),
        ),
    ]
    return _flags(spark, d, "customer_dirty", "c_custkey", rules)


@query
def q05_outlier(spark, d):
    rules = [
        Rule("default_bounds", "", "statistical_outlier", ("c_acctbal",)),
        Rule("own_bounds", "", "statistical_outlier", ("c_acctbal",), parameters={"lo": "-500", "hi": "5000"}),
    ]
    return _flags(spark, d, "customer_dirty", "c_custkey", rules)


@query
def q06_unique(spark, d):
    rules = [
        Rule("line_key", "", "multi_record", ("l_orderkey", "l_linenumber"), parameters={"unique": "true"}),
        Rule("part_present", "", "multi_record", ("l_partkey",)),
    ]
    return ev.score_rules(table(spark, d, "lineitem"), rules)


@query
def q07_temporal(spark, d):
    return _flags(spark, d, "events_text", "event_id", [Rule("ok", "", "temporal", ("event_day",))])


@query
def q08_pattern(spark, d):
    rules = [
        Rule("not_blank", "", "pattern", ("text",)),
        Rule("has_mail", "", "pattern", ("text",), parameters={"regex": "[A-Za-z0-9.]+@[A-Za-z0-9]+\\.[A-Za-z0-9.]+"}),
        Rule("not_text", "", "pattern", ("n_chars",)),
    ]
    return _flags(spark, d, "documents", "doc_id", rules)


@query
def q09_condition_mix(spark, d):
    rules = [
        Rule(
            "mix", "",
            conditions=(
                {"field": "o_orderstatus", "operator": "equals", "value": "F"},
                {"field": "o_totalprice", "operator": "greater_than", "value": "100000", "logicalOperator": "AND"},
                {"field": "o_orderpriority", "operator": "contains", "value": "URGENT", "logicalOperator": "OR"},
                {"field": "o_custkey", "operator": "not_equals", "value": "7", "logicalOperator": "AND"},
            ),
        ),
        Rule("early", "", conditions=({"field": "o_orderdate", "operator": "less_than", "value": "1996-01-01"},)),
        Rule("absent", "", conditions=({"field": "no_such_column", "operator": "not_null"},)),
    ]
    return _flags(spark, d, "orders", "o_orderkey", rules)


@query
def q10_pass_fail_by_dataset(spark, d):
    return ev.pass_fail(table(spark, d, "runs"), F.col("score") >= S.PASS_SCORE, ["dataset_id"])


@query
def q10b_pass_fail_by_segment(spark, d):
    flagged = ev.rule_flags(table(spark, d, "customer_dirty"), CUSTOMER_RULES)
    return ev.pass_fail(flagged, F.col("complete"), ["c_mktsegment"])


@query
def q10c_pass_fail_by_rule(spark, d):
    results = ev.evaluate(table(spark, d, "customer_dirty"), CUSTOMER_RULES, "c_custkey", "none")
    return ev.pass_fail(results, F.col("passed"), ["rule_id"])


# ---- profiling ----------------------------------------------------------------------


@query
def q11_infer_types(spark, d):
    orders = table(spark, d, "orders").select(
        *[F.col(c).cast("string") for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")],
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
    )
    return profile.infer_column_types(orders, orders.columns)


@query
def q11b_infer_types_dirty(spark, d):
    text = table(spark, d, "events_text")
    return profile.infer_column_types(text, text.columns)


@query
def q12_schema_check(spark, d):
    template = [
        {"field_name": "event_id", "field_type": "number", "required": True},
        {"field_name": "event_day", "field_type": "date", "required": False},
        {"field_name": "flag", "field_type": "boolean", "required": True},
        {"field_name": "event_type", "field_type": "string", "required": True},
        {"field_name": "no_such_field", "field_type": "string", "required": True},
    ]
    return profile.check_schema(table(spark, d, "events_text"), template)


@query
def q12b_preview(spark, d):
    names = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return profile.preview(names, order=["c_custkey"])


@query
def q12c_dataset_stats(spark, d):
    names = ("customer", "orders", "lineitem", "events", "documents", "embeddings")
    return profile.dataset_stats({n: table(spark, d, n) for n in names})


# ---- run metrics --------------------------------------------------------------------


@query
def q13_run_metrics(spark, d):
    return metrics.run_metrics(table(spark, d, "runs"), datetime(1996, 1, 1), datetime(2000, 12, 31))


@query
def q14_dataset_ranking(spark, d):
    return metrics.dataset_ranking(metrics.completed_runs(table(spark, d, "runs"), datetime(1900, 1, 1), datetime(2100, 1, 1)))


@query
def q15_trend(spark, d):
    return metrics.quality_trend(table(spark, d, "runs"), "month").withColumn("period", F.date_format("period", "yyyy-MM-dd"))


@query
def q16_period_change(spark, d):
    monthly = table(spark, d, "runs").groupBy("dataset_id", F.date_trunc("month", "started_at").alias("period")).agg(
        F.max("score").alias("score"), F.count(F.lit(1)).alias("runs")
    )
    changed = metrics.period_change(monthly, ["score", "runs"], by=["dataset_id"])
    return changed.withColumn("period", F.date_format("period", "yyyy-MM-dd"))


@query
def q16b_score_bands(spark, d):
    runs = table(spark, d, "runs")
    return runs.groupBy(S.score_band(F.col("score")).alias("band"), S.run_outcome(F.col("score")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("runs")
    )


@query
def q16c_report_context(spark, d):
    return metrics.report_context(table(spark, d, "runs"), "ds3")


@query
def q16d_report_scorings(spark, d):
    scored = classify(table(spark, d, "scored"), 0.5)
    summary = anomaly_summary(scored, 0.5, by=["scoring_id"])
    started = table(spark, d, "scored").groupBy("scoring_id").agg(F.max("detected_at").alias("started_at"))
    runs = summary.join(started, "scoring_id").select(
        F.col("scoring_id").alias("id"), F.col("scoring_id").alias("dataset_id"), F.lit("completed").alias("status"),
        "started_at", F.struct("anomaly_count", "anomaly_percentage").alias("summary"),
    )
    return metrics.report_scorings(runs)


# ---- conflicts and rule tables ------------------------------------------------------


def _rules(spark, d) -> DataFrame:
    fields = F.filter(F.array("f1", "f2"), lambda f: f.isNotNull())
    return table(spark, d, "rules").withColumn("target_fields", fields)


def _pairs(found: DataFrame) -> DataFrame:
    return found.select("rule_a", "rule_b", "a_scope", "b_scope", "parent_id", "pair_key")


@query
def q17_conflicts_catalog_table(spark, d):
    return _pairs(conflicts.conflicts(_rules(spark, d), conflicts.KINDS[0]))


@query
def q17b_groups_catalog_table(spark, d):
    """The same conflicts as groups."""
    return conflicts.conflict_groups(_rules(spark, d), conflicts.KINDS[0])


@query
def q18_conflicts_table_column(spark, d):
    return _pairs(conflicts.conflicts(_rules(spark, d), conflicts.KINDS[1]))


@query
def q18b_groups_table_column(spark, d):
    return conflicts.conflict_groups(_rules(spark, d), conflicts.KINDS[1])


@query
def q19_conflicts_catalog_column(spark, d):
    return _pairs(conflicts.conflicts(_rules(spark, d), conflicts.KINDS[2]))


@query
def q19d_groups_catalog_column(spark, d):
    return conflicts.conflict_groups(_rules(spark, d), conflicts.KINDS[2])


@query
def q19b_rule_conflicts(spark, d):
    """Exact numbers of conflicts and one partner of each rule, all kinds."""
    rules = _rules(spark, d)
    first, second, third = (conflicts.rule_conflicts(rules, k) for k in conflicts.KINDS)
    return first.unionByName(second).unionByName(third)


@query
def q19c_conflict_pairs(spark, d):
    """The pairs themselves, for the rules of one catalog."""
    rules = _rules(spark, d).where(F.col("catalog_id") == 4)
    return _pairs(conflicts.conflicts(rules, conflicts.KINDS[0]))


def _resolutions(spark, d) -> DataFrame:
    return table(spark, d, "resolutions").select(
        S.pair_key(F.col("rule_lo"), F.col("rule_hi")).alias("pair_key"), "priority_rule_id", "overridden_rule_id",
        "resolved_by", "resolved_at",
    )


@query
def q20_with_resolutions(spark, d):
    found = conflicts.conflicts_with_resolutions(_rules(spark, d), _resolutions(spark, d))
    return found.select("rule_a", "rule_b", "resolved", "priority_rule_id", "resolved_by")


@query
def q20d_resolved_conflicts(spark, d):
    """The conflicts that have a resolution, found from the resolutions."""
    found = conflicts.resolved_conflicts(_rules(spark, d), _resolutions(spark, d))
    return found.select("rule_a", "rule_b", "a_scope", "b_scope", "parent_id", "priority_rule_id", "resolved_by")


@query
def q20b_conflict_sentences(spark, d):
    return conflicts.describe(conflicts.conflict_totals(_rules(spark, d))).select("contradiction_summary", "conflicts")


@query
def q20c_open_conflicts(spark, d):
    return conflicts.open_conflicts(_rules(spark, d), _resolutions(spark, d))


@query
def q21_resolve(spark, d):
    resolved = conflicts.resolve_all(_rules(spark, d), _resolutions(spark, d))
    return resolved.select("rule_id", "scope", "status")


@query
def q21b_resolve_one(spark, d):
    updated, _ = conflicts.resolve_conflict(_rules(spark, d), [3, 7, 12], 7, "admin", datetime(2024, 1, 1))
    return updated.select("rule_id", "status")


def _registry(spark, d) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "registry_tables"), table(spark, d, "registry_fields")


@query
def q22_expand_rules(spark, d):
    """Every field that each rule applies to."""
    active = _rules(spark, d).where(F.col("status") == "active")
    return conflicts.expand_rules(active, *_registry(spark, d))


@query
def q22d_rule_ranges(spark, d):
    """The interval of fields that each rule applies to."""
    active = _rules(spark, d).where(F.col("status") == "active")
    return conflicts.rule_ranges(active, conflicts.scope_labels(*_registry(spark, d)))


@query
def q22c_rules_of_tables(spark, d):
    """The fields that each rule applies to, of the tables of one catalog and of the one without."""
    active = _rules(spark, d).where(F.col("status") == "active")
    tables, fields = _registry(spark, d)
    return conflicts.expand_rules(active, tables, fields, tables.where(F.col("catalog_id").isin(1, 99)))


@query
def q22b_active_rules(spark, d):
    bound = _rules(spark, d).withColumn("dataset_id", F.concat(F.lit("ds"), (F.col("rule_id") % 12).cast("string")))
    return conflicts.active_rules(bound, "ds4").select("rule_id", "scope", "catalog_id")


# ---- cleaning -----------------------------------------------------------------------


@query
def q23_row_diff(spark, d):
    diff = row_diff(table(spark, d, "customer_dirty"), table(spark, d, "customer_cleaned"), ["c_custkey"])
    return diff.select("c_custkey", "change", F.array_join("changed_columns", ",").alias("changed_columns"))


@query
def q24_clean_summary(spark, d):
    diff = row_diff(table(spark, d, "customer_dirty"), table(spark, d, "customer_cleaned"), ["c_custkey"])
    return cleaning_summary(diff)


@query
def q24b_clean_summary_shape(spark, d):
    diff = row_diff(table(spark, d, "customer_dirty"), table(spark, d, "customer_cleaned"), ["c_custkey"])
    return cleaning_summary(diff, mode="shape")


@query
def q25_dedup_clean(spark, d):
    docs = table(spark, d, "documents").drop("doc_id")
    return clean.drop_duplicate_rows(docs).select(F.md5("text").alias("text_md5"), "lang", "source", "n_chars")


@query
def q25b_clean_steps(spark, d):
    steps = clean.plan_steps(
        ["duplicate rows", "missing values in c_name", "inconsistent text in c_name", "outliers found in c_acctbal"],
        {"c_name": {"value": "Unknown"}, "c_acctbal": {"lo": 0.0, "hi": 9000.0}},
    )
    return clean.clean(table(spark, d, "customer_dirty"), clean.compile_steps(steps))


@query
def q25c_fill_typed(spark, d):
    """Missing numbers, times and text, filled without changing a column's type."""
    holes = table(spark, d, "orders").select(
        "o_orderkey", *[F.when(F.col("o_orderkey") % k != 0, F.col(c)).alias(c) for k, c in
                        ((3, "o_custkey"), (4, "o_totalprice"), (5, "o_orderdate"), (7, "o_orderpriority"))])
    given = {"o_custkey": {"value": -1}, "o_totalprice": {"value": "0.5"}, "o_orderdate": {"value": "1990-01-01"}}
    steps = clean.plan_steps([f"missing values in {c}" for c in holes.columns[1:]], given)
    return clean.clean(holes, clean.compile_steps(steps))


# ---- audit --------------------------------------------------------------------------


def _audit_out(df: DataFrame) -> DataFrame:
    return df.select("audit_id", "user_id", "action_type", "resource_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query
def q26_audit_user(spark, d):
    return _audit_out(
        audit_ops.audit_by_user(
            table(spark, d, "audit"), 100, start=datetime(1995, 1, 1), end=datetime(2000, 12, 31), ts="ts", tie="audit_id"
        )
    )


@query
def q27_audit_resource(spark, d):
    return _audit_out(audit_ops.audit_by_resource_type(table(spark, d, "audit"), "rule", action="update", ts="ts"))


@query
def q28_audit_months(spark, d):
    return _audit_out(
        audit_ops.audit_by_time(
            table(spark, d, "audit"), datetime(1997, 3, 10), datetime(1998, 2, 5), action="create", ts="ts", tie="audit_id"
        )
    )


@query
def q28b_audit_rows(spark, d):
    rows = audit_ops.audit_rows(
        table(spark, d, "orders"), F.col("o_custkey"), F.lit("update"), F.lit("dataset"), F.col("o_orderkey"), F.col("o_orderdate")
    )
    return rows.select(
        "user_id", "action_type", "resource_type", "resource_id", "year_month",
        S.composite_key(F.col("resource_type"), F.col("resource_id")).alias("resource_key"),
    )


# ---- listings -----------------------------------------------------------------------


@query
def q29_keyset_page(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    order = [("o_custkey", "desc"), ("o_orderkey", "asc")]
    return listing.keyset_page(orders, order, after=[100, 500], n=50)


@query
def q29b_audit_cursor(spark, d):
    """Where every page of the audit trail ends, read back from its cursor."""
    audit = table(spark, d, "audit")
    pages = audit_ops.audit_pages(audit, "ts", "audit_id")
    ts, tie = listing.cursor_values(F.col("cursor"), audit, ["ts", "audit_id"])
    return pages.select("page", "rows", F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("last_ts"), tie.alias("last_id"))


@query
def q29c_audit_page(spark, d):
    """The second page of audit rows, after the cursor that the first one gives."""
    audit = table(spark, d, "audit").select("audit_id", "ts", "user_id")
    first = audit_ops.audit_page(audit, None, None, "ts", "audit_id").collect()
    return audit_ops.audit_page(audit, first[-1]["cursor"], None, "ts", "audit_id").select("audit_id", "user_id")


@query
def q30_search_any(spark, d):
    found = listing.search_any(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "fURn")
    return found


@query
def q31_offset_page(spark, d):
    return listing.offset_page(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"], 7, 25)


@query
def q31d_deep_page(spark, d):
    return listing.offset_page(table(spark, d, "lineitem").select(*LINE_ORDER), LINE_ORDER, 1500, 40)


@query
def q31b_total_pages(spark, d):
    return listing.total_pages(table(spark, d, "orders"), 20)


@query
def q31c_sort_as_text(spark, d):
    return listing.sort_as_text(table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey", "desc")


@query
def q32_rule_listing(spark, d):
    return listing.list_rules(_rules(spark, d), scope="nowhere", status="active", catalog_id=4, created="rule_id").select(
        "rule_id", "scope", "status", "catalog_id"
    )


@query
def q32b_catalog_listing(spark, d):
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.col("o_custkey").alias("owner"),
        F.col("o_orderdate").alias("created_at"),
    )
    found = listing.list_catalogs(orders, name="HIGH", after=datetime(1996, 1, 1), before=datetime(1999, 1, 1))
    return found.select("id", "name", "owner", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query
def q32c_count_where(spark, d):
    return listing.count_where(table(spark, d, "orders"), F.col("o_orderstatus") == "F")


@query
def q32d_lookup(spark, d):
    found = listing.lookup(table(spark, d, "orders"), o_orderkey=77, o_custkey=table_key(spark, d))
    return listing.project(found, ["o_orderkey", "o_orderstatus"])


def table_key(spark, d) -> int:
    return listing.lookup(table(spark, d, "orders"), o_orderkey=77).first()["o_custkey"]


@query
def q32e_tables_of_catalog(spark, d):
    """All tables, and again those of one catalog."""
    tables = table(spark, d, "registry_tables")
    every = listing.list_tables(tables).withColumn("asked", F.lit(None).cast("int"))
    return every.unionByName(listing.list_tables(tables, 2).withColumn("asked", F.lit(2)))


@query
def q32f_fields_of_table(spark, d):
    return listing.list_fields(table(spark, d, "registry_fields"), 7)


@query
def q32g_templates_of_catalog(spark, d):
    """All templates, those of one catalog, and of one without associations."""
    templates = table(spark, d, "nation").select(F.col("n_nationkey").alias("template_id"), F.col("n_name").alias("name"))
    associations = table(spark, d, "customer").select((F.col("c_custkey") % 30).alias("template_id"), (F.col("c_custkey") % 11).alias("catalog_id"))
    asked = lambda c: listing.list_templates(templates, associations, c).withColumn("asked", F.lit(c).cast("int"))
    return asked(None).unionByName(asked(4)).unionByName(asked(77))


@query
def q59c_recipients(spark, d):
    """Who is told of each kind of event, of one kind, and of one that nobody set up."""
    people = table(spark, d, "customer").where("c_acctbal > 0").groupBy("c_nationkey").agg(F.min("c_name").alias("first"), F.max("c_name").alias("last"))
    kinds = table(spark, d, "nation").join(people, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(
        F.col("n_name").alias("event_type"), F.when(F.col("n_nationkey") % 4 != 0, F.array("first", "last")).alias("recipients"),
        F.lit(None).cast("timestamp").alias("updated_at"), F.col("first").alias("updated_by"),
    )
    found = [listing.list_recipients(kinds, e).withColumn("asked", F.lit(e).cast("string")) for e in (None, "CHINA", "ATLANTIS")]
    rows = found[0].unionByName(found[1]).unionByName(found[2])
    return rows.select("asked", "event_type", F.array_join("emails", ",").alias("emails"), "updated_by")


# ---- versions and state -------------------------------------------------------------


@query
def q33_versions(spark, d):
    done = reports.report_versions(table(spark, d, "report_versions"))
    return done.select("report_id", "version", "edited_by", "content", "current_version", "next_version")


@query
def q33b_edit_report(spark, d):
    versions = table(spark, d, "report_versions").withColumns({"title": F.lit("t"), "edited_at": F.lit(None).cast("timestamp")})
    edits = table(spark, d, "conversations").select("conv_id").distinct().select(
        F.col("conv_id").alias("report_id"),
        F.when(F.col("conv_id") % 2 == 0, "new text").alias("content"),
        F.when(F.col("conv_id") % 3 == 0, "new title").alias("title"),
        F.lit("me").alias("edited_by"),
        F.lit(None).cast("timestamp").alias("edited_at"),
    )
    return reports.edit_report(versions, edits).select("report_id", "version", "content", "title", "edited_by")


@query
def q33c_publish(spark, d):
    made = table(spark, d, "conversations").select(
        (F.col("conv_id") * 10 + F.col("turn")).cast("bigint").alias("id"),
        F.when(F.col("conv_id") % 4 == 0, "published").otherwise("draft").alias("status"),
        F.lit(None).cast("timestamp").alias("published_at"),
        F.lit(None).cast("timestamp").alias("updated_at"),
    )
    asked = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    updated, refused = reports.publish_report(made, asked, datetime(2024, 1, 1))
    return updated.select("id", F.col("status").alias("outcome")).unionByName(
        refused.select("id", F.col("reason").alias("outcome"))
    )


@query
def q34_latest_state(spark, d):
    latest = latest_per_key(table(spark, d, "runs"), ["dataset_id"], ["started_at", "run_id"])
    return latest.select("dataset_id", "run_id", "status", "score")


@query
def q34b_latest_of_many(spark, d):
    """The last line of every part, and of every customer the last order of the highest price."""
    lines = table(spark, d, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity")
    last = latest_per_key(lines, ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber"])
    dear = latest_per_key(table(spark, d, "orders").select("o_custkey", "o_totalprice", "o_orderkey"), ["o_custkey"], ["o_totalprice", "o_orderkey"])
    made = last.select(F.lit("part").alias("kind"), F.col("l_partkey").alias("key"), F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").cast("bigint").alias("line"))
    return made.unionByName(dear.select(F.lit("customer").alias("kind"), F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("order_key"), F.lit(0).cast("bigint").alias("line")))


# ---- anomalies ----------------------------------------------------------------------

LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _line_errors(spark, d, clip) -> DataFrame:
    """Mean squared scaled distance per line: a reconstruction error that SQL can state."""
    lines = table(spark, d, "lineitem")
    stats = scaler_stats(lines, LINE_COLUMNS).collect()
    z = [scaled(lines, r["column_name"], r["mean"], r["std"], clip) for r in stats]
    error = sum((c * c for c in z[1:]), z[0] * z[0]) / len(z)
    return lines.select("l_orderkey", "l_partkey", "l_linenumber", error.alias("reconstruction_error"))


@query
def q35_scaler(spark, d):
    stats = scaler_stats(table(spark, d, "lineitem"), LINE_COLUMNS)
    return stats.select("column_name", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query
def q35b_scale_clip(spark, d):
    return _line_errors(spark, d, (0.0, 1.0)).agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.avg("reconstruction_error"), 4).alias("mean_error"),
        F.round(F.max("reconstruction_error"), 4).alias("max_error"),
    )


@query
def q36_threshold(spark, d):
    errors = _line_errors(spark, d, None)
    value = exact_percentile(errors, "reconstruction_error", 95.0)
    return errors.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.round(F.lit(value), 6).alias("threshold"))


@query
def q37_severity(spark, d):
    return classify(table(spark, d, "scored"), 0.5).select("record_id", "severity", "is_anomaly")


@query
def q38_anomaly_summary(spark, d):
    one = anomaly_summary(classify(table(spark, d, "scored"), 0.5), 0.5)
    kinds = [F.coalesce(F.try_element_at("severity_counts", F.lit(s)), F.lit(0)).alias(s) for s in S.SEVERITIES]
    return one.select("total_records", "anomaly_count", "anomaly_percentage", "threshold", *kinds)


def _violations(spark, d) -> DataFrame:
    found = classify(table(spark, d, "scored"), 0.5).where("is_anomaly")
    return found.withColumns(
        {
            "score": F.col("reconstruction_error"),
            "resolved": F.col("record_id") % 3 == 0,
            "dataset_id": F.col("scoring_id"),
        }
    )


@query
def q39_by_field(spark, d):
    found = metrics.anomalies_by_field(_violations(spark, d), ["field", "severity"])
    return found.withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss"))


@query
def q39b_anomaly_cards(spark, d):
    return metrics.anomaly_cards(_violations(spark, d))


@query
def q39c_anomalous_of_run(spark, d):
    found = listing.anomalous(classify(table(spark, d, "scored"), 0.5), 8)
    return found.select("record_id", "severity", "reconstruction_error")


@query
def q39d_scorable(spark, d):
    models = table(spark, d, "runs").select(F.col("run_id").alias("model_id"), "status")
    asked = table(spark, d, "events").select(F.col("event_id").alias("scoring_id"), (F.col("event_id") * 2).alias("model_id"))
    accepted, rejected = scorable(asked, models)
    return accepted.withColumn("reason", F.lit("")).unionByName(rejected)


LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query
def q40_pca_score(spark, d):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    lines = table(spark, d, "lineitem").withColumns({"net": net, "charge": net * (1 + F.col("l_tax"))})
    # The three prices move together, so the first axis stands out and is the same for any solver.
    model = train_pca(lines, k=1, columns=["l_quantity", "l_extendedprice", "net", "charge"])
    scored = classify(reconstruction_error(lines, model), model.threshold)
    return scored.select(*LINE_ORDER, F.round("reconstruction_error", 6).alias("reconstruction_error"), "severity", "is_anomaly")


@query
def q41_autoencoder_score(spark, d):
    """Train, score every row, and state what holds for any good run."""
    lines = table(spark, d, "lineitem")
    model = train_autoencoder(lines, order=LINE_ORDER, columns=LINE_COLUMNS, epochs=10)
    untrained = replace(model, weights=[float(w) for w in init_weights(len(LINE_COLUMNS), model.encoding_dim, 42)])
    scored = reconstruction_error(reconstruction_error(lines, model, "e"), untrained, "e0")
    first, _ = split_ordered(scored.select(*LINE_ORDER, "e"), LINE_ORDER, 0.8)
    above = first.agg(F.avg((F.col("e") > model.threshold).cast("double")).alias("share"))
    facts = scored.agg(F.count(F.lit(1)).alias("scored"), (F.avg("e") < F.avg("e0")).alias("loss_fell"))
    return facts.crossJoin(above).select(
        "scored", F.lit(model.training_samples).cast("long").alias("training_rows"), F.lit(model.epochs_trained).alias("epochs"),
        "loss_fell", F.col("share").between(0.04, 0.06).alias("threshold_fits"),
    )


def formula_weights(n: int, k: int) -> list[float]:
    """Weights and zero biases by a formula that SQL can state: 0.3 sin(7 i + 3 j + layer), i and j from 0."""
    sizes, out = layer_sizes(n, k), []
    for layer, (a, b) in enumerate(zip(sizes, sizes[1:])):
        out += [0.3 * math.sin(7 * i + 3 * j + layer) for i in range(a) for j in range(b)] + [0.0] * b
    return out


@query
def q41b_network_score(spark, d):
    """Score every row with a network of known weights."""
    lines = table(spark, d, "lineitem")
    stats = scaler_stats(lines, LINE_COLUMNS).collect()
    model = Model(
        "autoencoder", LINE_COLUMNS, [r["mean"] for r in stats], [r["std"] for r in stats], 0.0, 1.0, 16,
        formula_weights(len(LINE_COLUMNS), 16),
    )
    scored = reconstruction_error(lines, model)
    e = F.col("reconstruction_error")
    return scored.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(e), 3).alias("mean_error"))


@query
def q42_export_rows(spark, d):
    scored = classify(table(spark, d, "scored"), 0.5).where("is_anomaly")
    rows = scored.withColumn("field_values", S.field_values(["field", "scoring_id"]))
    return export_rows(rows, anomaly_fields(rows))


@query
def q42b_export_long(spark, d):
    scored = classify(table(spark, d, "scored"), 0.5).where("is_anomaly")
    return export_long(scored.withColumn("field_values", S.field_values(["field", "scoring_id"])))


@query
def q43_split_ordered(spark, d):
    first, _ = split_ordered(table(spark, d, "lineitem").select(*LINE_ORDER), LINE_ORDER, 0.8)
    return first


@query
def q44_row_index(spark, d):
    return with_row_index(table(spark, d, "lineitem").select(*LINE_ORDER), LINE_ORDER)


# ---- registry -----------------------------------------------------------------------


@query
def q45_template_join(spark, d):
    associations = table(spark, d, "registry_tables").withColumnRenamed("catalog_id", "template_id")
    templates = table(spark, d, "region").select(F.col("r_regionkey").alias("template_id"), F.col("r_name").alias("template"))
    return catalog.templates_of_catalog(associations, templates).join(
        table(spark, d, "registry_fields").select("field_id", "table_id"), "table_id"
    ).select("field_id", "table_id", "template_id", "template")


def _associated(spark, d):
    tables = table(spark, d, "registry_fields").select(
        F.col("field_id").alias("table_id"), "name", F.lit(None).cast("int").alias("catalog_id")
    )
    catalogs = table(spark, d, "region").select(F.col("r_regionkey").alias("catalog_id"))
    pairs = table(spark, d, "orders").select(
        (F.col("o_orderkey") % 5000).alias("table_id"), (F.col("o_orderkey") % 7).cast("int").alias("catalog_id")
    ).groupBy("table_id").agg(F.min("catalog_id").alias("catalog_id"))
    return catalog.associate(tables, catalogs, pairs)


@query
def q46_association_reject(spark, d):
    return _associated(spark, d)[2].select("table_id", "catalog_id", "reason")


@query
def q46b_association_tables(spark, d):
    return _associated(spark, d)[1].select("table_id", "catalog_id")


@query
def q46c_children_and_orphans(spark, d):
    tables = table(spark, d, "registry_tables")
    catalogs = table(spark, d, "region").select(F.col("r_regionkey").alias("catalog_id"))
    fields = table(spark, d, "registry_fields").join(tables.select("table_id", "catalog_id"), "table_id")
    kept = catalog.children_of(fields, catalogs, "catalog_id").select("field_id", F.lit("kept").alias("state"))
    lost = catalog.orphans(fields, catalogs, "catalog_id").select("field_id", F.lit("orphan").alias("state"))
    return kept.unionByName(lost)


@query
def q46d_cascade_delete(spark, d):
    tables, fields = table(spark, d, "registry_tables"), table(spark, d, "registry_fields")
    doomed = tables.where(F.col("catalog_id") == 99)
    kept_tables, kept_fields = catalog.cascade_delete(tables, fields, doomed, "table_id")
    return kept_fields.select("table_id", "field_id").unionByName(
        kept_tables.select("table_id", F.lit(-1).cast("bigint").alias("field_id"))
    )


RECIPIENTS = {
    "validation_completion": ["ann@example.com", "bob@example.com"],
    "anomaly_scoring_completion": ["ann@example.com"],
}


def _recipients(spark) -> DataFrame:
    return spark.createDataFrame(list(RECIPIENTS.items()), "event_type string, recipients array<string>")


@query
def q47_notify_fanout(spark, d):
    sent = notify.notify_fanout(table(spark, d, "notifications"), _recipients(spark), F.col("id"), F.col("sent_at"))
    return sent.select("event_id", "event_type", "recipient", "status", "retry_count")


@query
def q48_delivery(spark, d):
    return notify.delivery_stats(table(spark, d, "notifications"))


@query
def q49_field_counts(spark, d):
    return catalog.field_counts(table(spark, d, "registry_tables"), table(spark, d, "registry_fields"))


@query
def q50_catalog_totals(spark, d):
    return catalog.catalog_totals(table(spark, d, "registry_sizes"), ["catalog_id"])


@query
def q51_dashboard(spark, d):
    scored = classify(table(spark, d, "scored"), 0.5)
    runs = table(spark, d, "runs")
    return metrics.dashboard_stats(runs, runs, scored, _rules(spark, d))


# ---- metadata checks ----------------------------------------------------------------


def _error_text(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.array_join("errors", "; ").alias("errors"))


@query
def q52_metadata_lint(spark, d):
    return _error_text(lint.lint_fields(table(spark, d, "registry_fields")), "field_id")


@query
def q52b_lint_rules(spark, d):
    return _error_text(lint.lint_rules(_rules(spark, d)), "rule_id")


@query
def q52c_lint_catalogs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("name"), F.col("text").alias("description"),
                                               F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("owner"))
    return _error_text(lint.lint_catalogs(docs), "doc_id")


@query
def q52d_lint_training(spark, d):
    jobs = table(spark, d, "lineitem").select(
        *LINE_ORDER,
        F.struct(
            F.col("l_discount").alias("learningRate"), F.col("l_quantity").alias("epochs"),
            F.col("l_partkey").alias("batchSize"), F.lit(None).cast("int").alias("encodingDimension"),
        ).alias("hyperparameters"),
    )
    linted = lint.lint_training_jobs(jobs)
    return _error_text(linted, *LINE_ORDER)


@query
def q53_emails_in_text(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "[ \n]")).alias("word"))
    found = words.where(F.col("word").contains("@"))
    return found.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(S.valid_email(F.col("word"))).alias("valid")
    )


# ---- rule text ----------------------------------------------------------------------


@query
def q54_rule_text_parse(spark, d):
    texts = table(spark, d, "rule_texts")
    described = ruletext.preview_rules(ruletext.parse_rule_text(texts, "answer"))
    return described.select(
        "rule_id", F.col("definition.type").alias("type"), F.array_join("definition.targetFields", ",").alias("targets"),
        F.size("definition.conditions").alias("n_conditions"), "rule_name", "conditions_summary", "target_scope", "expected_behavior",
    )


@query
def q54b_no_rule_in_prose(spark, d):
    talk = ruletext.parse_rule_text(table(spark, d, "conversations"), "text")
    return talk.groupBy("role").agg(F.count(F.lit(1)).alias("texts"), F.count("definition").alias("definitions"))


@query
def q55_retention(spark, d):
    kept = purge_expired(table(spark, d, "events"), "ts", datetime(2024, 4, 10), 90)
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"), F.min("event_id").alias("first_id"))


def _short_name(record: dict) -> bool:
    if record["c_acctbal"] < 0:
        raise ValueError("negative balance")
    return record["c_name"] is not None and len(record["c_name"].strip()) > 8


@query
def q56_python_rule(spark, d):
    rule = Rule("name_long", "name long", target_fields=("c_name", "c_acctbal"), function=_short_name)
    clean_balance = table(spark, d, "customer_dirty").withColumn("c_acctbal", F.coalesce(F.nanvl("c_acctbal", F.lit(0.0)), F.lit(0.0)))
    return ev.python_rules(clean_balance, [rule], "c_custkey")


def _reveal(record: dict) -> bool:
    if record["n"] is None or record["n"] % 2:
        raise ValueError(str(record["n"]))
    return record["n"] > 2**53 + 5000


@query
def q56b_python_types(spark, d):
    """Nullable whole numbers past 2**53 reach a Python rule as they are."""
    n = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") + 2**53)
    rule = Rule("reveal", "reveal", target_fields=("n",), function=_reveal)
    return ev.python_rules(table(spark, d, "orders").select("o_orderkey", n.alias("n")), [rule], "o_orderkey")


@query
def q57_admit_files(spark, d):
    return check_files(table(spark, d, "files")).select("page_id", "is_valid", "reason", "content_type")


# ---- listings and mutations ---------------------------------------------------------


@query
def q58_listing_runs(spark, d):
    found = listing.list_runs(table(spark, d, "runs"), dataset_id="ds5", status="completed")
    return found.withColumn("started_at", F.date_format("started_at", "yyyy-MM-dd"))


@query
def q58b_run_results(spark, d):
    results = ev.evaluate(table(spark, d, "customer_dirty"), CUSTOMER_RULES, "c_custkey", "failed")
    one = listing.run_results(results.withColumn("run_id", F.col("record_id") % 10), 3)
    return one.select("run_id", "record_id", "rule_id", "passed", F.element_at("field_values", "c_mktsegment").alias("segment"))


@query
def q59_notifications(spark, d):
    found = listing.list_notifications(table(spark, d, "notifications"), "report_publication")
    return found.select("id", "event_type", "status", "retry_count")


@query
def q60_upsert(spark, d):
    runs = table(spark, d, "runs").select("run_id", "dataset_id", "score")
    changes = table(spark, d, "events").select(
        (F.col("event_id") * 3).alias("run_id"), F.lit("new").alias("dataset_id"), F.col("value").alias("score")
    )
    return upsert(runs, changes, ["run_id"])


@query
def q60b_update_rules(spark, d):
    changes = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("rule_id"), F.when(F.col("s_suppkey") % 2 == 0, "draft").alias("status"),
        F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).alias("natural_language"),
    )
    return update_columns(_rules(spark, d), changes, ["rule_id"], ["status", "natural_language"]).select(
        "rule_id", "status", "natural_language"
    )


@query
def q60c_delete(spark, d):
    gone = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"))
    return delete_keys(table(spark, d, "runs").select("run_id", "dataset_id"), gone, ["run_id"])


@query
def q52e_lint_recipients(spark, d):
    words = F.filter(F.split("text", "[ \n]"), lambda w: w.contains("@"))
    people = table(spark, d, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 2 == 0, "report_publication").otherwise("newsletter").alias("event_type"),
        words.alias("recipients"),
    )
    return _error_text(lint.lint_recipients(people), "doc_id")


@query
def q52f_lint_tables(spark, d):
    named = table(spark, d, "part").select("p_partkey", F.expr("repeat(p_name, p_partkey % 40)").alias("name"))
    return _error_text(lint.lint_tables(named), "p_partkey")


@query
def q52g_lint_templates(spark, d):
    part = table(spark, d, "part")
    kind = F.when(F.col("p_size") % 4 == 0, " Number").when(F.col("p_size") % 4 == 1, "uuid").otherwise("date")
    fields = F.array(
        F.struct(F.col("p_brand").alias("field_name"), kind.alias("field_type"), F.lit(True).alias("required")),
        F.struct(F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")).alias("field_name"), F.lit("string").alias("field_type"),
                 F.lit(False).alias("required")),
    )
    return _error_text(lint.lint_templates(part.select("p_partkey", F.col("p_name").alias("name"), fields.alias("fields"))), "p_partkey")


@query
def q58c_run_detail(spark, d):
    runs = table(spark, d, "runs").withColumns(
        {
            "rule_ids": F.when(F.col("run_id") % 2 == 0, F.array(F.lit("r1"), F.lit("r2"))),
            "summary": F.when(F.col("run_id") % 2 == 0, F.create_map(F.lit("passed"), F.lit("1"))),
        }
    )
    one = listing.run_detail(runs, 77)
    return one.select("run_id", "dataset_id", "status", F.size("rule_ids").alias("rules"), F.size("summary").alias("facts"))


@query
def q59b_report_listing(spark, d):
    made = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "published").otherwise("draft").alias("status"),
        F.col("o_orderdate").alias("created_at"),
    )
    return reports.list_reports(made, "published").select("id", "status", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query
def q61_parse_iso(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    form = F.col("o_orderkey") % 5
    text = (
        F.when(form == 0, day).when(form == 1, F.concat(day, F.lit("T01:02:03"))).when(form == 2, F.concat(day, F.lit("T01:02:03Z")))
        .when(form == 3, F.concat(day, F.lit("T01:02:03+02:00"))).otherwise(F.concat(F.lit("on "), day))
    )
    parsed = S.parse_iso(text)
    return table(spark, d, "orders").select(
        "o_orderkey", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("parsed"), S.year_month(parsed).alias("month")
    )


@query
def q62_target_fields(spark, d):
    texts = table(spark, d, "rule_texts")
    fields = S.target_fields(F.col("answer"))
    return texts.select("rule_id", F.array_join(fields, ",").alias("fields"), F.size(fields).alias("n"))


@query
def q63_truncate(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", S.truncate(F.col("text"), 500).alias("description"), F.length(S.strip(F.col("text"))).alias("whole_length"))


@query
def q64_field_value_types(spark, d):
    """Rules over text-typed numbers and timestamps: comparisons take the bound's type."""
    texts = table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("user_text"), "ts", "event_type")
    rules = [
        Rule("above", "", conditions=({"field": "user_text", "operator": "greater_than", "value": "90"},)),
        Rule("in_week", "", conditions=({"field": "ts", "operator": "between", "value": "2024-01-08,2024-01-15"},)),
        Rule("kinds", "", conditions=({"field": "event_type", "operator": "matches", "value": "^(view|click)$"},)),
    ]
    return ev.rule_flags(texts, rules).select("event_id", "above", "in_week", "kinds")


BIG = 2**53 + 1


@query
def q64b_big_numbers(spark, d):
    """Neighbours past 2**53, as whole numbers and as text, in every comparison."""
    near = F.lit(BIG - 3) + F.col("o_orderkey") % 7
    orders = table(spark, d, "orders").select("o_orderkey", near.alias("n"), near.cast("string").alias("t"))
    rules = [
        Rule(f"{c}_{name}", "", conditions=({"field": c, "operator": op, "value": value},))
        for c in ("n", "t")
        for name, op, value in (("eq", "equals", str(BIG)), ("ne", "not_equals", BIG), ("gt", "greater_than", BIG),
                                ("lt", "less_than", str(BIG)), ("in", "between", f"{BIG},{BIG + 1}"))
    ]
    return ev.rule_flags(orders, rules).select("o_orderkey", *[r.id for r in rules])


@query
def q64c_long_numbers(spark, d):
    """Fractions past 2**53, exponents and numbers of 40 digits, all as text, against bounds of that kind."""
    key = F.col("o_orderkey")
    text = (
        F.when(key % 3 == 0, F.concat((F.lit(2**53 - 2) + key % 7).cast("string"), F.lit("."), (key % 10).cast("string")))
        .when(key % 3 == 1, F.concat(F.lit("900719925474099."), (key % 10).cast("string"), F.lit("e1")))
        .otherwise(F.concat(F.when(key % 2 == 0, "-").otherwise(""), F.lit("1234567890123456789012345678901234567"), F.lpad((key % 1000).cast("string"), 3, "0")))
    )
    rules = [
        Rule(name, "", conditions=({"field": "t", "operator": op, "value": value},))
        for name, op, value in (("above", "greater_than", "9007199254740993.5"), ("below", "less_than", "9007199254740993.5"),
                                ("inside", "between", "9007199254740993,9007199254740994.5"),
                                ("huge", "greater_than", "1234567890123456789012345678901234567500"),
                                ("deep", "less_than", "-1.2345678901234567890123456789012345675e39"))
    ]
    return ev.rule_flags(table(spark, d, "orders").select("o_orderkey", text.alias("t")), rules).select("o_orderkey", *[r.id for r in rules])
