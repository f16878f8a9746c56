"""Linear reconstruction model with the same contract as the autoencoder."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecheck.operators.autoencoder import PERCENTILE, fit_threshold
from tablecheck.operators.model import Model
from tablecheck.operators.scale import numeric_columns, scale_clip, scaler_stats


def train_pca(df: DataFrame, k: int, columns: list[str] | None = None) -> Model:
    """Principal components of the standardised columns; unclipped, so the data stay centred."""
    columns = columns or numeric_columns(df)
    stats = scaler_stats(df, columns).collect()
    z = scale_clip(df, stats, clip=None)
    vectors = VectorAssembler(inputCols=z.columns, outputCol="features").transform(z).select("features")
    components = PCA(k=k, inputCol="features", outputCol="p").fit(vectors).pc.toArray()
    model = Model(
        "pca", columns, [r["mean"] for r in stats], [r["std"] for r in stats], None, None, k,
        [float(x) for x in components.ravel()], percentile=PERCENTILE,
    )
    scored = pca_error(z, [F.col(c) for c in z.columns], model, "e")
    model.threshold = fit_threshold(scored, "e")
    model.training_samples = z.count()
    return model


def pca_error(df: DataFrame, z: list[Column], model: Model, out: str) -> DataFrame:
    """Mean squared distance to the projection, as plain Column arithmetic."""
    n, k = len(model.feature_names), model.encoding_dim
    weight = [model.weights[i * k : (i + 1) * k] for i in range(n)]
    add = lambda parts: reduce(lambda a, b: a + b, parts)
    named = df.withColumns({f"__z{i}": c for i, c in enumerate(z)})
    scores = {
        f"__s{j}": add([F.col(f"__z{i}") * F.lit(weight[i][j]) for i in range(n)]) for j in range(k)
    }
    named = named.withColumns(scores)
    gaps = [
        F.col(f"__z{i}") - add([F.col(f"__s{j}") * F.lit(weight[i][j]) for j in range(k)]) for i in range(n)
    ]
    error = add([g * g for g in gaps]) / F.lit(float(n))
    return named.withColumn(out, error).select(*df.columns, out)
