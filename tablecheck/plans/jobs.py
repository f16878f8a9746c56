"""Whole runs: validate, clean and score a dataset, with a ledger row per transition.

Each job reads, computes and writes through Spark; the driver handles one summary row. A
job that dies half-way can be run again under the same id: results replace each other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck import schemas
from tablecheck.functions import scalars as S
from tablecheck.functions.rules import Rule
from tablecheck.operators.autoencoder import (
    DEFAULT_THRESHOLD, anomaly_summary, classify, reconstruction_error, scorable,
)
from tablecheck.operators.clean import clean
from tablecheck.operators.diff import cleaning_summary, row_diff
from tablecheck.operators.evaluate import evaluate, python_rules, quality_score
from tablecheck.operators.model import Model
from tablecheck.operators.state import latest_per_key
from tablecheck.sources.readers import read_dataset
from tablecheck.sources.writers import append_run_state, cleaned_path, read_run, snapshot, write_like, write_results


def _ledger(spark: SparkSession, path: str, schema: str, **values) -> None:
    names = spark.createDataFrame([], schema).columns
    row = tuple(values.get(n) for n in names)
    append_run_state(spark.createDataFrame([row], schema), path)


def _tracked(run: Callable[[], dict], record: Callable[..., None]) -> dict:
    """Record completed with what ``run`` returns, or failed with the error text."""
    try:
        outcome = run()
    except Exception as e:
        record(status="failed", error_message=str(e), completed_at=datetime.now())
        raise
    record(status="completed", completed_at=datetime.now(), **outcome)
    return outcome


def current_state(ledger: DataFrame) -> DataFrame:
    """The row of each id's last start; of that run a finished state wins over the start row."""
    ranked = ledger.withColumn("__done", F.col("completed_at").isNotNull())
    start = "started_at" if "started_at" in ledger.columns else "executed_at"
    return latest_per_key(ranked, ["id"], [start, "__done", "completed_at"]).drop("__done")


def job_status(ledger: DataFrame, job_id: str) -> DataFrame:
    return current_state(ledger.where(F.col("id") == job_id))


def validation_job(
    spark: SparkSession, run_id: str, dataset_path: str, rules: Sequence[Rule], key: str, results_path: str,
    ledger_path: str, dataset_id: str | None = None, include_values: str = "all",
) -> dict:
    """Evaluate the rules, write one row per (record, rule) and score the run from what was written."""
    if not rules:
        raise ValueError("a run needs at least one active rule")
    started = datetime.now()
    base = dict(
        id=run_id, dataset_id=dataset_id, dataset_path=dataset_path, started_at=started,
        rules_count=len(rules), rule_ids=[r.id for r in rules],
    )

    def record(**values) -> None:
        _ledger(spark, ledger_path, schemas.VALIDATION_RUN, **base, **values)

    def run() -> dict:
        df = read_dataset(spark, dataset_path)
        at = F.lit(started)
        columns = [r for r in rules if r.function is None]
        python = [r for r in rules if r.function is not None]
        parts = [evaluate(df, columns, key, include_values, at)] if columns else []
        if python:
            found = python_rules(df, python, key, include_values=include_values)
            if include_values == "none":
                found = found.withColumn("field_values", F.lit(None).cast("map<string,string>"))
            parts.append(found.withColumn("evaluated_at", at))
        results = parts[0]
        for other in parts[1:]:
            results = results.unionByName(other)
        write_results(results, results_path, run_id)
        written = read_run(spark, results_path, results, "run_id", run_id)
        summary = quality_score(written, len(rules)).first()
        return {"score": summary["quality_score"], "summary": summary.asDict()}

    record(status="running")
    return _tracked(run, record)


def clean_job(
    spark: SparkSession, job_id: str, source: str, steps, key: list[str], backup: str, out_root: str,
    ledger_path: str, state: str = "pending_approval", issues: Sequence[str] = (),
) -> dict:
    """Snapshot, clean, write in the source's format, and summarise the keyed difference.

    The cleaned data go to a new path, so a failure leaves the source as it was.
    """
    if state != "pending_approval":
        raise ValueError(f"only a job pending approval can run, this one is {state}")
    base = dict(
        id=job_id, dataset_path=source, issues=list(issues), executed_at=datetime.now(), backup_path=backup
    )

    def record(**values) -> None:
        _ledger(spark, ledger_path, schemas.CLEANING_JOB, **base, **values)

    def run() -> dict:
        snapshot(spark, source, backup, job_id)
        before = read_dataset(spark, source)
        target = cleaned_path(out_root, job_id, source)
        cleaned = clean(before, steps)
        write_like(cleaned, source, target)
        after = read_dataset(spark, target, cleaned.schema)
        same = len(before.columns) == len(after.columns)
        summary = cleaning_summary(row_diff(before, after, key), same_columns=same).first()
        if summary["total_records"] != before.count():
            raise ValueError(f"key {key} is not unique")
        kept = {k: summary[k] for k in
                ("total_records", "modified_records", "unchanged_records", "error_records", "output_records")}
        return {"summary": {**kept, "output_path": target}}

    record(status="running")
    return _tracked(run, record)


def score_job(
    spark: SparkSession, scoring_id: str, model_id: str, models: DataFrame, model: Model, df: DataFrame,
    key: str, results_path: str, ledger_path: str, threshold: float = DEFAULT_THRESHOLD,
    dataset_id: str | None = None,
) -> dict:
    """Score every record with a completed model, write the scores and summarise them."""
    asked = spark.createDataFrame([(scoring_id, model_id)], "scoring_id string, model_id string")
    _, rejected = scorable(asked, models)
    refused = rejected.first()
    if refused:
        raise ValueError(f"{refused['reason']}: {model_id}")
    started = datetime.now()
    base = dict(id=scoring_id, model_id=model_id, dataset_id=dataset_id, threshold=threshold, started_at=started)

    def record(**values) -> None:
        _ledger(spark, ledger_path, schemas.SCORING_RUN, **base, **values)

    def run() -> dict:
        scored = classify(reconstruction_error(df, model), threshold).select(
            F.lit(scoring_id).alias("scoring_id"),
            F.col(f"`{key}`").cast("string").alias("record_id"),
            "reconstruction_error",
            "severity",
            "is_anomaly",
            S.field_values(df.columns).alias("field_values"),
            F.lit(started).alias("scored_at"),
        )
        (
            scored.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("scoring_id")
            .parquet(results_path)
        )
        written = read_run(spark, results_path, scored.drop("scoring_id"), "scoring_id", scoring_id)
        return {"summary": anomaly_summary(written, threshold).first().asDict()}

    record(status="running")
    return _tracked(run, record)
