"""Audit trail: rows from change batches, and the three ways to look them up."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecheck.functions import scalars as S
from tablecheck.operators.listing import AUDIT_PAGE_DEFAULT, cursor_page, page_cursors

# ---- fixed values -------------------------------------------------------------------
ACTIONS = ("create", "update", "delete")
RESOURCES = (
    "catalog", "table", "field", "template", "rule", "validation", "anomaly_training",
    "anomaly_scoring", "cleaning", "report", "notification", "dataset",
)
RETENTION_DAYS = 365
# -------------------------------------------------------------------------------------


def audit_rows(
    changes: DataFrame, user_id: Column, action: Column, resource_type: Column, resource_id: Column,
    at: Column, details: Column | None = None,
) -> DataFrame:
    """One audit row per changed row; write it with ``partitionBy("year_month")``."""
    none = F.create_map().cast("map<string,string>")
    ts = at.cast("timestamp")
    return changes.select(
        S.stable_id(user_id, action, resource_type, resource_id, ts).alias("id"),
        user_id.cast("string").alias("user_id"),
        action.alias("action_type"),
        resource_type.alias("resource_type"),
        resource_id.cast("string").alias("resource_id"),
        ts.alias("timestamp"),
        (F.coalesce(details, none) if details is not None else none).alias("details"),
        S.year_month(ts).alias("year_month"),
    )


def check_filters(
    action: str | None = None, resource_type: str | None = None,
    start: datetime | None = None, end: datetime | None = None,
) -> None:
    if action and action not in ACTIONS:
        raise ValueError(f"action_type must be one of {ACTIONS}")
    if resource_type and resource_type not in RESOURCES:
        raise ValueError(f"resource_type must be one of {RESOURCES}")
    if start and end and start > end:
        raise ValueError("start must not be after end")


def _between(df: DataFrame, ts: str, start: datetime | None, end: datetime | None) -> DataFrame:
    if start:
        df = df.where(F.col(ts) >= F.lit(start))
    if end:
        df = df.where(F.col(ts) <= F.lit(end))
    return df


def _newest_first(df: DataFrame, ts: str, tie: str) -> DataFrame:
    return df.orderBy(F.col(ts).desc(), F.col(tie))


def audit_by_user(
    audit: DataFrame, user_id, action: str | None = None, start: datetime | None = None,
    end: datetime | None = None, ts: str = "timestamp", tie: str = "id",
) -> DataFrame:
    check_filters(action=action, start=start, end=end)
    found = _between(audit.where(F.col("user_id") == user_id), ts, start, end)
    if action:
        found = found.where(F.col("action_type") == action)
    return _newest_first(found, ts, tie)


def audit_by_resource_type(
    audit: DataFrame, resource_type: str, action: str | None = None, start: datetime | None = None,
    end: datetime | None = None, ts: str = "timestamp",
) -> DataFrame:
    check_filters(action, resource_type, start, end)
    found = _between(audit.where(F.col("resource_type") == resource_type), ts, start, end)
    return found.where(F.col("action_type") == action) if action else found


def audit_by_time(
    audit: DataFrame, start: datetime, end: datetime, action: str | None = None,
    resource_type: str | None = None, ts: str = "timestamp", tie: str = "id",
) -> DataFrame:
    """Every month in range. The month bound prunes a table partitioned by year_month."""
    check_filters(action, resource_type, start, end)
    months = F.col("year_month").between(start.strftime("%Y-%m"), end.strftime("%Y-%m"))
    found = _between(audit.where(months), ts, start, end)
    if action:
        found = found.where(F.col("action_type") == action)
    if resource_type:
        found = found.where(F.col("resource_type") == resource_type)
    return _newest_first(found, ts, tie)


def audit_page(found: DataFrame, token: str | None = None, n: object = None, ts: str = "timestamp", tie: str = "id") -> DataFrame:
    """A page of audit rows, newest first, after a cursor; 50 rows unless asked otherwise."""
    return cursor_page(found, [(ts, "desc"), (tie, "asc")], token, n, AUDIT_PAGE_DEFAULT)


def audit_pages(audit: DataFrame, ts: str = "timestamp", tie: str = "id") -> DataFrame:
    """page, rows and cursor of every page of 50 of the whole trail, newest first."""
    return page_cursors(audit, [(ts, "desc"), (tie, "asc")], AUDIT_PAGE_DEFAULT)
