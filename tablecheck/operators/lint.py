"""Batch checks of metadata rows: each adds an ``errors`` array, empty when the row is fine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecheck.functions import scalars as S
from tablecheck.functions.rules import CATEGORIES
from tablecheck.operators.listing import RULE_SCOPES, RULE_STATUSES
from tablecheck.operators.notify import EVENT_TYPES, MAX_RECIPIENTS
from tablecheck.operators.profile import FIELD_TYPES

# ---- fixed values -------------------------------------------------------------------
NAME_MAX, TABLE_NAME_MAX, DESCRIPTION_MAX, RULE_TEXT_MAX = 100, 200, 500, 500
HYPERPARAMETERS = {
    "learningRate": (0.0001, 0.01),
    "epochs": (10, 500),
    "batchSize": (16, 256),
    "encodingDimension": (4, 64),
}
HYPERPARAMETER_DEFAULTS = {"learningRate": 0.001, "epochs": 100, "batchSize": 32, "encodingDimension": 16}
# -------------------------------------------------------------------------------------


def _with_errors(df: DataFrame, checks: list[tuple[Column, str]]) -> DataFrame:
    found = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(msg)) for bad, msg in checks])
    return df.withColumn("errors", F.filter(found, lambda e: e.isNotNull()))


def split_valid(linted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows (without ``errors``) and rejected rows (with them)."""
    ok = F.size("errors") == 0
    return linted.where(ok).drop("errors"), linted.where(~ok)


def _missing(c: Column) -> Column:
    return ~F.coalesce(S.not_blank(c.cast("string")), F.lit(False))


def _longer(c: Column, n: int) -> Column:
    return F.length(S.strip(c)) > n


def _name_checks(limit: int) -> list[tuple[Column, str]]:
    return [
        (_missing(F.col("name")), "name: required"),
        (_longer(F.col("name"), limit), f"name: longer than {limit}"),
    ]


def lint_catalogs(df: DataFrame) -> DataFrame:
    too_long = _longer(F.col("description"), DESCRIPTION_MAX)
    return _with_errors(
        df,
        [
            *_name_checks(NAME_MAX),
            (_missing(F.col("owner")), "owner: required"),
            (too_long, f"description: longer than {DESCRIPTION_MAX}"),
        ],
    )


def lint_tables(df: DataFrame) -> DataFrame:
    return _with_errors(df, _name_checks(TABLE_NAME_MAX))


def lint_fields(df: DataFrame) -> DataFrame:
    kind = F.lower(S.strip(F.col("field_type")))
    return _with_errors(
        df,
        [
            (_missing(F.col("name")), "name: required"),
            (_missing(F.col("field_type")), "field_type: required"),
            (~_missing(F.col("field_type")) & ~kind.isin(*FIELD_TYPES), "field_type: not a known type"),
        ],
    )


def lint_templates(df: DataFrame) -> DataFrame:
    """Checks the name and every element of the ``fields`` array."""
    def bad(f: Column) -> Column:
        kind = F.lower(S.strip(f["field_type"]))
        return _missing(f["field_name"]) | F.coalesce(~kind.isin(*FIELD_TYPES), F.lit(True))

    return _with_errors(
        df,
        [
            *_name_checks(NAME_MAX),
            (F.exists("fields", bad), "fields: a field has no name or no known type"),
        ],
    )


def lint_rules(df: DataFrame) -> DataFrame:
    scope = F.col("scope")
    return _with_errors(
        df,
        [
            (_missing(F.col("natural_language")), "natural_language: required"),
            (_longer(F.col("natural_language"), RULE_TEXT_MAX), f"natural_language: longer than {RULE_TEXT_MAX}"),
            (_missing(scope), "scope: required"),
            (~scope.isin(*RULE_SCOPES), "scope: not a known scope"),
            (_missing(F.col("catalog_id")), "catalog_id: required"),
            (scope.isin("table", "column") & _missing(F.col("table_id")), "table_id: required for this scope"),
            ((scope == "column") & _missing(F.col("column_id")), "column_id: required for this scope"),
            (~F.col("template_category").isin(*CATEGORIES), "template_category: not a known category"),
            (~F.col("status").isin(*RULE_STATUSES), "status: not a known status"),
        ],
    )


def lint_recipients(df: DataFrame) -> DataFrame:
    return _with_errors(
        df,
        [
            (F.coalesce(~F.col("event_type").isin(*EVENT_TYPES), F.lit(True)), "event_type: not a known type"),
            (F.size("recipients") > MAX_RECIPIENTS, f"recipients: more than {MAX_RECIPIENTS}"),
            (F.exists("recipients", lambda e: ~S.valid_email(e)), "recipients: an address is not valid"),
        ],
    )


def lint_training_jobs(df: DataFrame, column: str = "hyperparameters") -> DataFrame:
    """Bounds on each hyperparameter; an absent one takes its default."""
    checks = []
    for name, (lo, hi) in HYPERPARAMETERS.items():
        checks.append((~F.col(f"{column}.{name}").between(lo, hi), f"{name}: not between {lo} and {hi}"))
    filled = F.struct(
        *[F.coalesce(F.col(f"{column}.{k}"), F.lit(v)).alias(k) for k, v in HYPERPARAMETER_DEFAULTS.items()]
    )
    return _with_errors(df, checks).withColumn(column, filled)
