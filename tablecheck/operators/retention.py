"""Retention: keep what is young enough; drop what has expired."""

from __future__ import annotations

from datetime import datetime, timedelta
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------
RESULT_DAYS, EXPORT_DAYS, AUDIT_DAYS = 90, 7, 365
# -------------------------------------------------------------------------------------


def purge_expired(df: DataFrame, ts: str, as_of: datetime, days: int) -> DataFrame:
    """Rows not older than ``days`` at ``as_of``; the plain comparison reaches the scan."""
    return df.where(F.col(ts) >= F.lit(as_of - timedelta(days=days)))


def drop_prefix(spark: SparkSession, path: str) -> int:
    """Delete everything under ``path``; returns how many files that were."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return 0
    removed = fs.getContentSummary(target).getFileCount()
    fs.delete(target, True)
    return removed


def partition_values(spark: SparkSession, path: str, partition: str) -> list[str]:
    """Values of a partition column, from the folder names; no row is read."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(path, f"{partition}=*")
    fs = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.globStatus(pattern) or []]
    return sorted(unquote(n.split("=", 1)[1]) for n in names)


def purge_table(spark: SparkSession, path: str, partition: str, ts: str, as_of: datetime, days: int) -> int:
    """Purge a Parquet table partitioned by a date or month text column, in place.

    Partitions wholly past the limit are deleted; the one the limit falls into is rewritten;
    younger ones are not touched. Returns the number of partitions touched.
    """
    limit = as_of - timedelta(days=days)
    table = spark.read.parquet(path)
    touched = 0
    for value in partition_values(spark, path, partition):
        edge = limit.strftime("%Y-%m-%d")[: len(value)]
        if value < edge:
            drop_prefix(spark, f"{path}/{partition}={value}")
            touched += 1
        elif value == edge:
            kept = table.where((F.col(partition) == value) & (F.col(ts) >= F.lit(limit)))
            _rewrite(spark, kept, path, partition, value)
            touched += 1
    spark.catalog.refreshByPath(path)
    return touched


def _rewrite(spark: SparkSession, kept: DataFrame, path: str, partition: str, value: str) -> None:
    if kept.isEmpty():
        drop_prefix(spark, f"{path}/{partition}={value}")
        return
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)

