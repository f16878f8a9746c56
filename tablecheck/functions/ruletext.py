"""Rule definitions in free text: find the JSON, normalise it, describe it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecheck.functions import scalars as S
from tablecheck.functions.rules import CATEGORIES

# Loose shape first: any element may have the wrong type in hand-written JSON.
_RAW = (
    "type STRING, conditions STRING, targetFields STRING, expectedBehavior STRING, parameters STRING"
)
_CONDITIONS = "array<struct<field:string,operator:string,value:string,logicalOperator:string>>"
_STRICT = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}


def _object_or_null(candidate: Column) -> Column:
    """The candidate if it is exactly one JSON object, else null.

    Parsing it as a one-element array rejects anything that follows the closing brace.
    """
    text = S.strip(candidate)
    wrapped = F.concat(F.lit("["), text, F.lit("]"))
    parsed = F.from_json(wrapped, "array<map<string,string>>", _STRICT)
    ok = text.startswith("{") & (F.size(parsed) == 1) & F.element_at(parsed, 1).isNotNull()
    return F.when(ok, text)


def find_json(text: Column) -> Column:
    """The rule's JSON inside free text, or null.

    In order: the whole text; the first ```json fence, or else the first ``` fence; the
    span from the first { to the last }.
    """
    json_fence = F.regexp_extract(text, r"(?s)```json(.*?)```", 1)
    any_fence = F.regexp_extract(text, r"(?s)```(.*?)```", 1)
    fenced = F.when(text.contains("```json"), json_fence).otherwise(any_fence)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.coalesce(*[_object_or_null(c) for c in (text, fenced, braces)])


def normalize_definition(raw: Column) -> Column:
    """A loosely parsed definition (all parts text) to the rule-definition STRUCT, every part
    coerced to its type."""
    conditions = F.from_json(raw["conditions"], _CONDITIONS, _STRICT)
    conditions = F.filter(conditions, lambda c: c.isNotNull())
    conditions = F.transform(
        conditions,
        lambda c: F.struct(
            F.coalesce(c["field"], F.lit("")).alias("field"),
            F.coalesce(c["operator"], F.lit("")).alias("operator"),
            c["value"].alias("value"),
            c["logicalOperator"].alias("logicalOperator"),
        ),
    )
    listed = F.from_json(raw["targetFields"], "array<string>", _STRICT)
    single = F.when(F.length(raw["targetFields"]) > 0, F.array(raw["targetFields"]))
    targets = F.when(raw["targetFields"].startswith("["), listed).otherwise(single)
    parameters = F.from_json(raw["parameters"], "map<string,string>", _STRICT)
    empty_conditions = F.array().cast(_CONDITIONS)
    normalized = F.struct(
        F.when(raw["type"].isin(*CATEGORIES), raw["type"]).otherwise("simple").alias("type"),
        F.when(raw["conditions"].startswith("["), conditions)
        .otherwise(empty_conditions)
        .alias("conditions"),
        F.coalesce(targets, F.array().cast("array<string>")).alias("targetFields"),
        F.coalesce(raw["expectedBehavior"], F.lit("")).alias("expectedBehavior"),
        F.coalesce(parameters, F.create_map().cast("map<string,string>")).alias("parameters"),
    )
    return F.when(raw.isNotNull(), normalized)


def parse_rule_text(df: DataFrame, text: str, out: str = "definition") -> DataFrame:
    """Add the normalised definition found in the text column, null where there is none."""
    # one projection per step, so that the text is searched and parsed once per row
    found = df.withColumn("__json", find_json(F.col(f"`{text}`")))
    loose = found.withColumn("__raw", F.from_json("__json", _RAW, _STRICT))
    return loose.withColumn(out, normalize_definition(F.col("__raw"))).drop("__json", "__raw")


def _and_more(total: Column, shown: int, suffix: str) -> Column:
    more = F.concat(F.lit(" (+"), (total - shown).cast("string"), F.lit(suffix))
    return F.when(total > shown, more).otherwise("")


def preview_rules(
    df: DataFrame,
    definition: str = "definition",
    scope: str = "scope",
    catalog_id: str = "catalog_id",
    table_id: str = "table_id",
    column_id: str = "column_id",
) -> DataFrame:
    """Add rule_name, conditions_summary, target_scope and expected_behavior.

    Without a definition only the scope is described.
    """
    d = F.col(definition)
    fields, conditions = d["targetFields"], d["conditions"]
    title = F.concat(F.initcap(F.replace(d["type"], F.lit("_"), F.lit(" "))), F.lit(" Rule"))
    on = F.concat(F.lit(" on "), F.array_join(F.slice(fields, 1, 3), ", "))
    name = F.concat(
        title, F.when(F.size(fields) > 0, on).otherwise(""), _and_more(F.size(fields), 3, " more)")
    )
    parts = F.transform(
        F.slice(conditions, 1, 5),
        lambda c: F.concat_ws(" ", c["field"], c["operator"], F.coalesce(c["value"], F.lit("None"))),
    )
    summary = F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise(
        "No specific conditions defined"
    )
    cat, tab, col = (F.col(c).cast("string") for c in (catalog_id, table_id, column_id))
    q = F.lit("'")
    target = (
        F.when(F.col(scope) == "catalog", F.concat(F.lit("All tables in catalog "), q, cat, q))
        .when(
            F.col(scope) == "table",
            F.concat(F.lit("Table "), q, tab, q, F.lit(" in catalog "), q, cat, q),
        )
        .when(
            F.col(scope) == "column",
            F.concat(F.lit("Column "), q, col, q, F.lit(" in table "), q, tab, q),
        )
        .otherwise(F.concat(F.lit("Scope: "), F.col(scope)))
    )
    return df.withColumns(
        {
            "rule_name": name,
            "conditions_summary": F.when(
                d.isNotNull(), F.concat(summary, _and_more(F.size(conditions), 5, " more conditions)"))
            ),
            "target_scope": target,
            "expected_behavior": d["expectedBehavior"],
        }
    )
