"""Run metrics, rankings, trends and dashboard figures."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecheck.functions import scalars as S

# ---- fixed values -------------------------------------------------------------------
LOOKBACK_DAYS = 30
RANKING_SIZE = 5
REPORT_RUNS, REPORT_SCORINGS, REPORT_SHOWN = 20, 10, 5
# -------------------------------------------------------------------------------------


def completed_runs(runs: DataFrame, start: datetime, end: datetime) -> DataFrame:
    return runs.where(
        (F.col("status") == "completed") & (F.col("started_at") >= F.lit(start)) & (F.col("started_at") <= F.lit(end))
    )


def run_metrics(runs: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """One row over completed runs in [start, end]; the default range is the last 30 days.

    Runs without a score count as runs and nowhere else. No runs at all gives null rates.
    """
    end = end or datetime.now()
    start = start or end - timedelta(days=LOOKBACK_DAYS)
    score = F.col("score")
    one = completed_runs(runs, start, end).agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count(score).alias("n"),
        F.avg(score).alias("mean"),
        F.count_if(score >= S.PASS_SCORE).alias("pass_count"),
        F.count_if(score < S.PASS_SCORE).alias("fail_count"),
    )
    any_run = F.col("total_runs") > 0
    return one.select(
        "total_runs",
        F.when(any_run, F.coalesce(F.round("mean", 2), F.lit(0.0))).alias("average_score"),
        "pass_count",
        "fail_count",
        F.when(any_run, S.rate(F.col("pass_count"), F.col("n"))).alias("pass_rate"),
        F.when(any_run, S.rate(F.col("fail_count"), F.col("n"))).alias("fail_rate"),
    )


def dataset_averages(runs: DataFrame) -> DataFrame:
    scored = runs.where(F.col("score").isNotNull())
    return scored.groupBy("dataset_id").agg(F.round(F.avg("score"), 2).alias("average_score"))


def dataset_ranking(runs: DataFrame, n: int = RANKING_SIZE) -> DataFrame:
    """ranking ("highest" | "lowest"), position, dataset_id, average_score: the n best and n worst."""
    averages = dataset_averages(runs)

    def top(name: str, order: Column) -> DataFrame:
        best = averages.orderBy(order, "dataset_id").limit(n)
        rows = best.agg(F.collect_list(F.struct("average_score", "dataset_id")).alias("r"))  # at most n rows
        sign = -1 if name == "highest" else 1
        ordered = F.array_sort(
            F.transform("r", lambda x: F.struct((x["average_score"] * sign).alias("k"), x["dataset_id"].alias("d")))
        )
        return rows.select(F.lit(name).alias("ranking"), F.posexplode(ordered).alias("i", "x")).select(
            "ranking",
            (F.col("i") + 1).cast("bigint").alias("position"),
            F.col("x.d").alias("dataset_id"),
            (F.col("x.k") * sign).alias("average_score"),
        )

    best = top("highest", F.col("average_score").desc())
    return best.unionByName(top("lowest", F.col("average_score").asc()))


def quality_trend(runs: DataFrame, grain: str = "day") -> DataFrame:
    """Average score per period."""
    scored = runs.where(F.col("score").isNotNull())
    return scored.groupBy(F.date_trunc(grain, "started_at").alias("period")).agg(
        F.round(F.avg("score"), 2).alias("average_score"), F.count(F.lit(1)).alias("runs")
    )


def period_change(
    periods: DataFrame, metrics: list[str], by: list[str] | None = None, grain: str = "month"
) -> DataFrame:
    """Each period against the calendar period before it: previous value, change, change in %.

    ``periods`` is already aggregated to one row per period (and ``by``). A self equi-join on
    the shifted period; no window over the whole table.
    """
    by = by or []
    step = {"day": "1 day", "week": "7 days", "month": "1 month", "year": "1 year"}[grain]
    shifted = (F.col("period").cast("timestamp") + F.expr(f"INTERVAL {step}")).alias("period")
    before = periods.select(
        *by, shifted, *[F.col(m).alias(f"{m}_previous") for m in metrics]
    )
    joined = periods.withColumn("period", F.col("period").cast("timestamp")).join(before, [*by, "period"], "left")
    out = []
    for m in metrics:
        now, then = F.col(m), F.col(f"{m}_previous")
        out += [
            now,
            then,
            F.round(now - then, 2).alias(f"{m}_change"),
            F.when(then != 0, F.round(100.0 * (now - then) / then, 2)).alias(f"{m}_change_pct"),
        ]
    return joined.select(*by, "period", *out)


def report_context(runs: DataFrame, dataset_id=None, limit: int = REPORT_RUNS) -> DataFrame:
    """Figures of the latest completed runs: how many, and average, lowest and highest score."""
    done = runs.where(F.col("status") == "completed")
    if dataset_id is not None:
        done = done.where(F.col("dataset_id") == dataset_id)
    recent = done.orderBy(F.col("started_at").desc(), "run_id").limit(limit)
    return recent.agg(
        F.count(F.lit(1)).alias("runs"),
        F.coalesce(F.round(F.avg("score"), 1), F.lit(0.0)).alias("average_score"),
        F.coalesce(F.min("score"), F.lit(0.0)).alias("lowest_score"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("highest_score"),
    )


def report_scorings(scorings: DataFrame, limit: int = REPORT_SCORINGS, shown: int = REPORT_SHOWN) -> DataFrame:
    """The scoring runs a report lists: of the latest ``limit`` completed ones, the first ``shown``."""
    done = scorings.where(F.col("status") == "completed")
    recent = done.orderBy(F.col("started_at").desc(), "id").limit(min(limit, shown))
    return recent.select(
        "id",
        "dataset_id",
        F.coalesce("summary.anomaly_count", F.lit(0)).alias("anomaly_count"),
        F.round(F.coalesce("summary.anomaly_percentage", F.lit(0.0)), 1).alias("anomaly_percentage"),
    )


def dashboard_stats(datasets: DataFrame, runs: DataFrame, scored: DataFrame, rules: DataFrame) -> DataFrame:
    """One row: datasets, mean quality score, anomalies, active rules, each from its own aggregate."""
    total = datasets.agg(F.count_distinct("dataset_id"))
    score = runs.where(F.col("status") == "completed").agg(F.coalesce(F.round(F.avg("score"), 2), F.lit(0.0)))
    anomalies = scored.agg(F.count_if("is_anomaly"))
    active = rules.agg(F.count_if(F.col("status") == "active"))
    return datasets.sparkSession.range(1).select(
        total.scalar().alias("total_datasets"),
        score.scalar().alias("quality_score"),
        anomalies.scalar().alias("anomalies_detected"),
        active.scalar().alias("rules_active"),
    )


def anomalies_by_field(violations: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per field (and further grouping): count, highest score, last time seen."""
    return violations.groupBy(*(by or ["field"])).agg(
        F.count(F.lit(1)).alias("count"),
        F.max("score").alias("max_score"),
        F.max("detected_at").alias("last_seen"),
    )


def anomaly_cards(violations: DataFrame) -> DataFrame:
    return violations.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if("resolved").alias("resolved"),
        F.count_distinct("dataset_id").alias("datasets_affected"),
    )
