"""Report versions: history, fallback content, edits and publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablecheck.operators.state import latest_per_key

# Versions per window group; a report with many more is filled block by block.
BLOCK = 10_000


def _slim(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Without the columns to fill, but with the order number of the rows that hold a value: ``__from_`` and the name."""
    held = {f"__from_{c}": F.when(F.col(c).isNotNull(), F.col(order)) for c in columns}
    return df.withColumns(held).drop(*columns)


def _carried(slim: DataFrame, key: str, order: str, columns: list[str], block: int) -> DataFrame:
    """Every row with the number of the closest row at or before it that holds a value.

    Each key is cut into blocks of ``order``, so one huge key is many window groups. The last
    number of each block (one small row per block) is then carried to later blocks.
    """
    numbers = [f"__from_{c}" for c in columns]
    blocked = slim.withColumn("__block", F.floor(F.col(order) / block))
    inside = Window.partitionBy(key, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = blocked.withColumns({n: F.max(n).over(inside) for n in numbers})
    ends = blocked.groupBy(key, "__block").agg(*[F.max(n).alias(n) for n in numbers])
    earlier = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(key, "__block", *[F.max(n).over(earlier).alias(f"__earlier{n}") for n in numbers])
    joined = filled.join(before, [key, "__block"], "left")
    latest = {n: F.coalesce(F.col(n), F.col(f"__earlier{n}")) for n in numbers}
    return joined.withColumns(latest).drop(*[f"__earlier{n}" for n in numbers])


def _with_values(carried: DataFrame, df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Fetch the values from the rows that hold them, each column in one join."""
    out = carried
    for c in columns:
        held = df.where(F.col(c).isNotNull()).select(key, F.col(order).alias(f"__from_{c}"), c)
        out = out.join(held, [key, f"__from_{c}"], "left")
    return out


def forward_fill(df: DataFrame, key: str, order: str, columns: list[str], block: int = BLOCK) -> DataFrame:
    """Fill nulls from the closest earlier row of the same key. ``order`` is a whole number, unique in its key.

    Windows and aggregates carry the number of the row that holds a value, never the value.
    """
    carried = _carried(_slim(df, order, columns), key, order, columns, block)
    return _with_values(carried, df, key, order, columns).select(*df.columns)


def report_versions(versions: DataFrame, fill: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Every version with fallback content, the report's current version and the next one."""
    fill = fill or ["content"]
    slim = _slim(versions, "version", fill)
    carried = _carried(slim, "report_id", "version", fill, block)
    # the current version is found per block first, and joined by block: no report is one hot key
    tops = carried.groupBy("report_id", "__block").agg(F.max("version").alias("top"))
    current = tops.select(
        "report_id", "__block", F.max("top").over(Window.partitionBy("report_id")).alias("current_version")
    )
    joined = carried.join(current, ["report_id", "__block"])
    whole = _with_values(joined, versions, "report_id", "version", fill)
    return whole.select(*versions.columns, "current_version", (F.col("current_version") + 1).alias("next_version"))


def version_list(versions: DataFrame, report_id) -> DataFrame:
    """Versions of one report, newest first."""
    mine = versions.where(F.col("report_id") == report_id)
    return mine.select("version", "edited_at", "edited_by").orderBy(F.col("version").desc())


def edit_report(versions: DataFrame, edits: DataFrame) -> DataFrame:
    """New version rows for a batch of edits (one per report): version + 1, with content and
    title falling back to the current ones. Edits of unknown reports, or that change nothing,
    produce no row."""
    current = latest_per_key(versions, ["report_id"], ["version"])
    wanted = edits.where(F.coalesce("content", "title").isNotNull()).alias("e")
    joined = wanted.join(current.alias("c"), "report_id")
    new = {
        "version": F.col("c.version") + 1,
        "content": F.coalesce("e.content", "c.content"),
        "title": F.coalesce("e.title", "c.title"),
        "edited_by": F.col("e.edited_by"),
        "edited_at": F.col("e.edited_at"),
    }
    return joined.select("report_id", *[v.alias(k) for k, v in new.items()])


def publish_report(reports: DataFrame, ids: DataFrame, at) -> tuple[DataFrame, DataFrame]:
    """Draft -> published. Returns the new report table and the ids that were refused, with a reason."""
    when = F.lit(at).cast("timestamp")
    asked = ids.select(F.col("id")).distinct()
    seen = asked.join(reports.select("id", "status"), "id", "left")
    reason = F.when(F.col("status").isNull(), "not found").when(F.col("status") != "draft", "not a draft")
    refused = seen.where(reason.isNotNull()).select("id", reason.alias("reason"))
    marked = reports.join(asked.withColumn("__asked", F.lit(True)), "id", "left")
    go = F.coalesce(F.col("__asked"), F.lit(False)) & (F.col("status") == "draft")
    updated = marked.withColumns(
        {
            "status": F.when(go, "published").otherwise(F.col("status")),
            "published_at": F.when(go, when).otherwise(F.col("published_at")),
            "updated_at": F.when(go, when).otherwise(F.col("updated_at")),
        }
    )
    return updated.select(*reports.columns), refused


def list_reports(reports: DataFrame, status: str | None = None) -> DataFrame:
    found = reports.where(F.col("status") == status) if status else reports
    return found.orderBy(F.col("created_at").desc_nulls_last(), "id")


def report_detail(reports: DataFrame, report_id) -> DataFrame:
    return reports.where(F.col("id") == report_id)
