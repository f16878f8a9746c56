"""Autoencoder training over partitions, scoring, thresholds and severities.

Each epoch is one Spark job: every partition runs mini-batch Adam over its own rows from
the same starting weights, and the resulting weights are averaged by row count (parallel
SGD with parameter averaging). The driver only ever holds one weight vector per branch of
the averaging tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecheck.functions import scalars as S
from tablecheck.operators.model import Model, errors, init_weights, loss_and_gradient, unpack
from tablecheck.operators.quantile import exact_percentile
from tablecheck.operators.rows import split_ordered
from tablecheck.operators.scale import numeric_columns, scale_clip, scaled, scaler_stats

# ---- fixed values -------------------------------------------------------------------
LEARNING_RATE, EPOCHS, BATCH_SIZE, ENCODING_DIM, PATIENCE = 0.001, 100, 32, 16, 10
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-7
PERCENTILE, TRAIN_SHARE, DEFAULT_THRESHOLD = 95.0, 0.8, 0.5
# -------------------------------------------------------------------------------------

FAN_IN = 32
_STATE = "n bigint, loss double, state array<float>"


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
    return np.column_stack(columns).astype(np.float32)


def _state_batch(n: int, loss: float, state: np.ndarray) -> pa.RecordBatch:
    column = pa.array([state], type=pa.list_(pa.float32()))
    return pa.RecordBatch.from_arrays([pa.array([n]), pa.array([loss]), column], ["n", "loss", "state"])


def _epoch(train: DataFrame, state: np.ndarray, step0: int, shape: tuple[int, int], lr: float, batch: int, seed: int):
    """One pass over the training rows; returns rows seen, summed loss and averaged state.

    ``state`` is weights, first moments and second moments laid end to end.
    """
    n_features, k = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, m, v = (part.copy() for part in np.split(state, 3))
        g, buf = np.empty_like(w), np.empty_like(w)
        layers, grads = unpack(w, n_features, k), unpack(g, n_features, k)
        rng, t, rows, loss = np.random.default_rng(seed), step0, 0, 0.0
        for b in batches:
            x = _matrix(b)
            x = x[rng.permutation(len(x))]
            for i in range(0, len(x), batch):
                part = x[i : i + batch]
                t += 1
                loss += loss_and_gradient(layers, part, grads) * len(part)
                rows += len(part)
                m *= BETA1
                m += np.multiply(g, 1 - BETA1, out=buf)
                v *= BETA2
                np.multiply(g, g, out=buf)
                buf *= 1 - BETA2
                v += buf
                np.sqrt(v, out=buf)
                buf /= math.sqrt(1 - BETA2**t)
                buf += EPSILON
                np.divide(m, buf, out=buf)
                buf *= lr / (1 - BETA1**t)
                w -= buf
        if rows:
            yield _state_batch(rows, loss, np.concatenate([w, m, v]) * np.float32(rows))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, loss, total = 0, 0.0, np.zeros(len(state), np.float64)
        for b in batches:
            rows += sum(b.column(0).to_pylist())
            loss += sum(b.column(1).to_pylist())
            for s in b.column(2):
                total += s.values.to_numpy()
        if rows:
            yield _state_batch(rows, loss, total.astype(np.float32))

    sums = train.mapInArrow(run, _STATE)
    parts = train.rdd.getNumPartitions()
    while parts > FAN_IN:
        parts = math.ceil(parts / FAN_IN)
        sums = sums.repartition(parts).mapInArrow(add, _STATE)
    got = sums.collect()  # at most FAN_IN rows of fixed width
    rows = sum(r["n"] for r in got)
    if not rows:
        raise ValueError("no training rows")
    total = np.sum([np.asarray(r["state"], np.float64) for r in got], axis=0)
    return rows, sum(r["loss"] for r in got) / rows, (total / rows).astype(np.float32)


def _mean_loss(data: DataFrame, weights: np.ndarray, shape: tuple[int, int]) -> float | None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layers, rows, loss = unpack(weights, *shape), 0, 0.0
        for b in batches:
            e = errors(layers, _matrix(b))
            rows, loss = rows + len(e), loss + float(e.sum())
        yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([loss])], ["n", "loss"])

    one = data.mapInArrow(run, "n bigint, loss double").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss")).first()
    return one["loss"] / one["n"] if one["n"] else None


def split_by_hash(df: DataFrame, columns: list[str], share: float = TRAIN_SHARE) -> tuple[DataFrame, DataFrame]:
    """About ``share`` of the rows by the hash of ``columns``; needs no order and no shuffle."""
    bucket = F.pmod(F.xxhash64(*columns), F.lit(10_000)) < int(share * 10_000)
    return df.where(bucket), df.where(~bucket)


def train_autoencoder(
    df: DataFrame,
    order: list[str] | None = None,
    split_on: list[str] | None = None,
    columns: list[str] | None = None,
    learning_rate: float = LEARNING_RATE,
    epochs: int = EPOCHS,
    batch_size: int = BATCH_SIZE,
    encoding_dim: int = ENCODING_DIM,
    clip: tuple[float, float] = (0.0, 1.0),
    patience: int = PATIENCE,
    seed: int = 42,
) -> Model:
    """Train on the first 80 % of rows in ``order`` (or by the hash of ``split_on``), stop when the
    validation loss has not improved for ``patience`` epochs, keep the best weights, and set the
    threshold to the 95th percentile of the training errors."""
    columns = columns or numeric_columns(df)
    if (order is None) == (split_on is None):
        raise ValueError("give either a total order or the columns to split on")
    stats = scaler_stats(df, columns).collect()
    needed = df.select(*dict.fromkeys([*(order or split_on), *columns]))
    first, rest = split_ordered(needed, order, TRAIN_SHARE) if order else split_by_hash(needed, split_on)
    # A file's splits without a row group are empty, and an ordered split leaves whole partitions to one side: the rows
    # are dealt evenly once, so that every core takes part in every epoch.
    cores = df.sparkSession.sparkContext.defaultParallelism
    train = scale_clip(first, stats, clip).repartition(cores).persist(StorageLevel.MEMORY_AND_DISK)
    held_out = scale_clip(rest, stats, clip).repartition(cores).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _fit(train, held_out, stats, learning_rate, epochs, batch_size, encoding_dim, clip, patience, seed)
    finally:
        train.unpersist()
        held_out.unpersist()


def _fit(train, held_out, stats, learning_rate, epochs, batch_size, k, clip, patience, seed) -> Model:
    shape = (len(stats), k)
    weights = init_weights(*shape, seed)
    state = np.concatenate([weights, np.zeros_like(weights), np.zeros_like(weights)])
    best, best_loss, waited, step, rows, loss, val, ran = weights, math.inf, 0, 0, 0, None, None, 0
    parts = train.rdd.getNumPartitions()
    for epoch in range(epochs):
        rows, loss, state = _epoch(train, state, step, shape, learning_rate, batch_size, seed + epoch)
        step += max(1, rows // (batch_size * parts))
        weights, ran = state[: len(best)], epoch + 1
        val = _mean_loss(held_out, weights, shape)
        watched = loss if val is None else val
        if watched < best_loss:
            best, best_loss, waited = weights.copy(), watched, 0
        else:
            waited += 1
            if waited >= patience:
                break
    model = Model(
        "autoencoder", [r["column_name"] for r in stats], [r["mean"] for r in stats], [r["std"] for r in stats],
        clip[0], clip[1], k, [float(x) for x in best], percentile=PERCENTILE, training_samples=rows,
        training_loss=loss, validation_loss=val, epochs_trained=ran,
    )
    z = [F.col(c) for c in train.columns]
    model.threshold = fit_threshold(train.select(_error_udf(model)(*z).alias("e")), "e")
    return model


def fit_threshold(errors_df: DataFrame, column: str, percentile: float = PERCENTILE) -> float:
    """Percentile of the training rows' errors. The error column is kept while it is searched."""
    kept = errors_df.select(column).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return exact_percentile(kept, column, percentile)
    finally:
        kept.unpersist()


def _error_udf(model: Model):
    weights = np.asarray(model.weights, np.float32)
    shape = (len(model.feature_names), model.encoding_dim)

    @F.pandas_udf("double")
    def error(*features: pd.Series) -> pd.Series:
        x = np.column_stack(features).astype(np.float32)
        return pd.Series(errors(unpack(weights, *shape), x).astype(np.float64))

    return error


def reconstruction_error(df: DataFrame, model: Model, out: str = "reconstruction_error") -> DataFrame:
    """Add the error column. Only the scaled features travel to Python; other columns stay put."""
    z = [scaled(df, s["column_name"], s["mean"], s["std"], model.clip) for s in model.stats]
    if model.kind == "pca":
        from tablecheck.operators.pca import pca_error

        return pca_error(df, z, model, out)
    return df.withColumn(out, _error_udf(model)(*z))


def classify(scored: DataFrame, threshold: float = DEFAULT_THRESHOLD, error: str = "reconstruction_error") -> DataFrame:
    """Add severity and is_anomaly; a missing or NaN error is normal."""
    e = F.col(error)
    return scored.withColumns({"severity": S.severity(e, threshold), "is_anomaly": S.is_anomaly(e, threshold)})


def anomaly_summary(classified: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    """total, anomaly_count, anomaly_percentage and a count per severity present, per ``by`` group."""
    by = by or []
    per = classified.groupBy(*by, "severity").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_anomaly").alias("a")
    )
    # five severities at most, so the map holds at most five entries per group
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n"))))
    return per.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"),
        F.coalesce(F.sum("a"), F.lit(0)).alias("anomaly_count"),
        counts.alias("severity_counts"),
    ).select(
        *by,
        "total_records",
        "anomaly_count",
        S.rate(F.col("anomaly_count"), F.col("total_records")).alias("anomaly_percentage"),
        "severity_counts",
        F.lit(float(threshold)).alias("threshold"),
    )


def scorable(scorings: DataFrame, models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scoring requests whose model exists and is completed, and the rejected ones with a reason."""
    joined = scorings.join(models.select("model_id", F.col("status").alias("__status")), "model_id", "left")
    reason = F.when(F.col("__status").isNull(), "model not found").when(
        F.col("__status") != "completed", "model not ready"
    )
    return (
        joined.where(F.col("__status") == "completed").select(*scorings.columns),
        joined.where(reason.isNotNull()).select(*scorings.columns, reason.alias("reason")),
    )
