"""Writers: results, cleaned data, snapshots, ledgers, exports."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecheck.sources.readers import CSV

# Columns an export may have for fields; more fields make long rows.
WIDEST = 10_000


def write_results(results: DataFrame, path: str, run_id: str) -> None:
    """Results of one run, partitioned by run_id. Running the same run again replaces its rows."""
    (
        results.withColumn("run_id", F.lit(run_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(path)
    )


def read_run(spark: SparkSession, path: str, results: DataFrame, column: str, run_id: str) -> DataFrame:
    """The rows of one run. Ids are read as text: types inferred from folder names would make 1 of 01."""
    fields = [f for f in results.schema.fields if f.name != column]
    schema = T.StructType([*fields, T.StructField(column, T.StringType())])
    return spark.read.schema(schema).parquet(path).where(F.col(column) == run_id)


def write_like(df: DataFrame, source_path: str, out: str) -> None:
    """Same format as the source path says; CSV keeps its header."""
    writer = df.write.mode("overwrite")
    if source_path.endswith(".parquet"):
        writer.parquet(out)
    else:
        writer.options(**CSV).csv(out)


def cleaned_path(root: str, job_id: str, source_path: str) -> str:
    return f"{root}/cleaned/{job_id}/{os.path.basename(source_path)}"


def snapshot(spark: SparkSession, source: str, backup: str, job_id: str | None = None) -> None:
    """Copy a dataset before cleaning; a complete backup is never overwritten.

    With a ``job_id`` a note beside the backup names the job. The same job, run again, keeps its complete
    backup and replaces an incomplete one; any other existing backup is refused.
    """
    mode, jvm = "errorifexists", spark.sparkContext._jvm
    if job_id is not None:
        note = jvm.org.apache.hadoop.fs.Path(backup.rstrip("/") + ".job")
        fs = note.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        done = jvm.org.apache.hadoop.fs.Path(backup, "_SUCCESS")
        if fs.exists(note):
            held = fs.open(note)
            owner = bytes(held.readAllBytes()).decode()
            held.close()
            if owner != job_id:
                raise ValueError(f"{backup} is the backup of job {owner}")
            if fs.exists(done):
                return
            mode = "overwrite"
        elif not fs.exists(jvm.org.apache.hadoop.fs.Path(backup)):
            out = fs.create(note)
            out.write(bytearray(job_id.encode()))
            out.close()
    df = spark.read.parquet(source) if source.endswith(".parquet") else _csv_text(spark, source)
    writer = df.write.mode(mode)
    writer.parquet(backup) if source.endswith(".parquet") else writer.options(**CSV).csv(backup)


def restore(spark: SparkSession, backup: str, target: str) -> None:
    """Put a snapshot back over the dataset."""
    df = spark.read.parquet(backup) if target.endswith(".parquet") else _csv_text(spark, backup)
    write_like(df, target, target)


def _csv_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.options(**CSV).csv(path)


def append_run_state(state: DataFrame, path: str) -> None:
    """Append ledger rows; the current state of a job is its latest row (``latest_per_key``)."""
    state.write.mode("append").parquet(path)


def export_anomalies(classified: DataFrame, out: str, fields: list[str] | None = None, widest: int = WIDEST) -> list[str] | None:
    """Anomalous records as CSV: record_id, reconstruction_error, severity and one column per
    field. Fields default to every key that occurs, in order; a field a record lacks is empty.
    Records with more than ``widest`` different fields are written in long rows instead, one for each field.
    Nothing is written when there is no anomaly. Returns the field columns.
    """
    rows = classified.where("is_anomaly")
    if rows.isEmpty():
        return None
    names = fields if fields is not None else anomaly_fields(rows, widest)
    wide = names is not None
    (export_rows(rows, names) if wide else export_long(rows)).write.mode("overwrite").options(**CSV).csv(out)
    return names if wide else ["field", "value"]


def anomaly_fields(rows: DataFrame, widest: int = WIDEST) -> list[str] | None:
    """Keys that occur in field_values, in order; None if there are more than ``widest``.

    Tasks keep different keys only, and no more than ``widest`` and one reach the driver, however many rows or keys there are.
    """
    keys = rows.select(F.explode(F.map_keys("field_values")).alias("k")).distinct().limit(widest + 1).collect()
    return sorted(r["k"] for r in keys) if len(keys) <= widest else None


def export_long(rows: DataFrame) -> DataFrame:
    """A row for each field of a record; a record without fields has one row, with neither field nor value."""
    return rows.select("record_id", "reconstruction_error", "severity", F.explode_outer("field_values").alias("field", "value"))


def export_rows(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select(
        "record_id",
        "reconstruction_error",
        "severity",
        *[F.try_element_at("field_values", F.lit(n)).alias(n) for n in names],
    )


