"""Catalog registry: associations, children, counts and cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecheck.operators.skew import grid_join, split_hot_join
from tablecheck.operators.state import row_hash


def templates_of_catalog(associations: DataFrame, templates: DataFrame) -> DataFrame:
    """Association rows with their template; associations to missing templates drop out.

    A template used by a large share of the associations, or listed very often, is cut into pieces.
    """
    return grid_join(associations, templates, ["template_id"], row_hash(associations), row_hash(templates))


def associate(
    tables: DataFrame, catalogs: DataFrame, pairs: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Attach tables to catalogs. Returns (association rows, tables with the back reference,
    rejected pairs with a reason). Both ends of a pair must exist; table ids in ``pairs`` are
    unique per batch."""
    checked = (
        pairs.join(tables.select("table_id").withColumn("__t", F.lit(True)), "table_id", "left")
        .join(catalogs.select("catalog_id").withColumn("__c", F.lit(True)), "catalog_id", "left")
    )
    reason = F.when(F.col("__t").isNull(), "table not found").when(F.col("__c").isNull(), "catalog not found")
    accepted = checked.where(reason.isNull()).select(*pairs.columns)
    rejected = checked.where(reason.isNotNull()).select(*pairs.columns, reason.alias("reason"))
    back = accepted.select("table_id", F.col("catalog_id").alias("__catalog_id"))
    updated = (
        tables.join(back, "table_id", "left")
        .withColumn("catalog_id", F.coalesce("__catalog_id", "catalog_id"))
        .select(*tables.columns)
    )
    return accepted, updated, rejected


def children_of(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Child rows whose parent exists (tables of catalogs, fields of tables); a parent of very many is cut into pieces."""
    known = parents.select(key).distinct()
    return split_hot_join(children, known, [key], row_hash(children)).select(*children.columns)


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Child rows that point to a parent that does not exist, or to none.

    Which parents are missed is asked for each distinct one; the children only meet that answer.
    """
    lost = children.select(key).distinct().join(parents.select(key).distinct(), key, "left_anti").where(F.col(key).isNotNull())
    pointing = split_hot_join(children, lost, [key], row_hash(children)).select(*children.columns)
    return pointing.unionByName(children.where(F.col(key).isNull()))


def field_counts(tables: DataFrame, fields: DataFrame) -> DataFrame:
    """Fields per table, counted, never stored; tables without fields count 0."""
    counts = fields.groupBy("table_id").agg(F.count(F.lit(1)).alias("field_count"))
    return tables.select("table_id").join(counts, "table_id", "left").select(
        "table_id", F.coalesce("field_count", F.lit(0)).alias("field_count")
    )


def catalog_totals(tables: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Tables, columns and rows per catalog, from per-table column_count and row_count."""
    totals = [
        F.count(F.lit(1)).alias("tables"),
        F.sum("column_count").alias("columns"),
        F.sum("row_count").alias("rows"),
    ]
    return tables.groupBy(*by).agg(*totals) if by else tables.agg(*totals)


def cascade_delete(
    children: DataFrame, associations: DataFrame, doomed: DataFrame, key: str
) -> tuple[DataFrame, DataFrame]:
    """Delete tables (or templates) by key together with their association rows."""
    gone = doomed.select(key).distinct()
    return (
        children.join(gone, key, "left_anti").select(*children.columns),
        associations.join(gone, key, "left_anti").select(*associations.columns),
    )
