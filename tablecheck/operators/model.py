"""Reconstruction models: the record kept after training, and the numpy network inside tasks."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tablecheck import schemas


@dataclass
class Model:
    kind: str
    feature_names: list[str]
    mean: list[float]
    std: list[float]
    clip_lo: float | None
    clip_hi: float | None
    encoding_dim: int
    weights: list[float]
    threshold: float | None = None
    percentile: float = 95.0
    training_samples: int = 0
    training_loss: float | None = None
    validation_loss: float | None = None
    epochs_trained: int = 0

    @property
    def clip(self) -> tuple[float, float] | None:
        return None if self.clip_lo is None else (self.clip_lo, self.clip_hi)

    @property
    def stats(self) -> list[dict]:
        return [
            {"column_name": c, "mean": m, "std": s}
            for c, m, s in zip(self.feature_names, self.mean, self.std)
        ]


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    spark.createDataFrame([asdict(model)], schemas.MODEL).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> Model:
    return Model(**spark.read.schema(schemas.MODEL).parquet(path).first().asDict())


def model_frame(spark: SparkSession, model: Model) -> DataFrame:
    return spark.createDataFrame([asdict(model)], schemas.MODEL)


# ---- the network --------------------------------------------------------------------


def layer_sizes(n: int, k: int) -> list[int]:
    return [n, 64, 32, k, 32, 64, n]


def init_weights(n: int, k: int, seed: int) -> np.ndarray:
    """Uniform Glorot weights, zero biases, one flat vector."""
    rng = np.random.default_rng(seed)
    sizes = layer_sizes(n, k)
    parts = []
    for a, b in zip(sizes, sizes[1:]):
        limit = np.sqrt(6.0 / (a + b))
        parts += [rng.uniform(-limit, limit, a * b), np.zeros(b)]
    return np.concatenate(parts).astype(np.float32)


def unpack(flat: np.ndarray, n: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views into the flat vector, one (W, b) per layer."""
    sizes, layers, at = layer_sizes(n, k), [], 0
    for a, b in zip(sizes, sizes[1:]):
        w = flat[at : at + a * b].reshape(a, b)
        at += a * b
        layers.append((w, flat[at : at + b]))
        at += b
    return layers


def activations(layers: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> list[np.ndarray]:
    """Outputs of every layer, the input first; ReLU inside, sigmoid last."""
    out = [x]
    for i, (w, b) in enumerate(layers):
        z = out[-1] @ w
        z += b
        if i < len(layers) - 1:
            np.maximum(z, 0, out=z)
        else:  # the sigmoid, in a form that cannot overflow
            z *= 0.5
            np.tanh(z, out=z)
            z += 1
            z *= 0.5
        out.append(z)
    return out


def errors(layers: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Mean squared difference per record."""
    return np.mean((activations(layers, x)[-1] - x) ** 2, axis=1)


def loss_and_gradient(
    layers: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray, gradient: list[tuple[np.ndarray, np.ndarray]]
) -> float:
    """Mean loss over the batch; its gradient is written into ``gradient``, laid out like ``layers``."""
    acts = activations(layers, x)
    y = acts[-1]
    diff = y - x
    delta = (2.0 / diff.size) * diff * y * (1 - y)
    for i in range(len(layers) - 1, -1, -1):
        gw, gb = gradient[i]
        np.dot(acts[i].T, delta, out=gw)
        np.sum(delta, axis=0, out=gb)
        if i:
            delta = delta @ layers[i][0].T
            delta *= acts[i] > 0
    return float(np.vdot(diff, diff)) / diff.size
