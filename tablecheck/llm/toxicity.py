"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios (operator 7).

Texts are lower-cased; n-grams of 3 to 5 characters are hashed to 2**20 buckets, and a document has a
bucket or not. For every bucket the share of toxic documents that have it is compared with the share of
the others: the log of that ratio scales the bucket's feature, and a logistic regression is fitted on
the scaled features. The FEATURES buckets whose ratio is most certain are used.

The classifier learns from a bounded sample of labelled documents of the training fold: the first
PER_CLASS of each label by a hash of the id; of equal texts among them one is learned from. Labels of repeated rows: toxic if any row says so; rows with a
null label or id, or without a document, teach nothing. Without both labels in the sample the score is the
share of toxic ones (0 if there are none). Null and empty texts have no n-grams and get the score of the
intercept. Whole texts are scored, in pieces of PIECE characters that overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.llm.common import held_out, slices, table, tidy, written

SIZES = (3, 4, 5)
BITS = 20
PER_CLASS = 3000
FEATURES = 4096
MIN_DOCS = 4
SMOOTH = 1.0
PENALTY = 2.0
STEPS = 200
THRESHOLD = 0.7
PIECE = 1 << 20


def buckets(text: str) -> Iterator[np.ndarray]:
    """Buckets of the text's n-grams, repeats included, an array for each size and piece."""
    text = text.lower()
    for at in range(0, max(len(text), 1), PIECE):
        c = np.frombuffer(text[at : at + PIECE + SIZES[-1] - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        h = np.zeros(len(c), np.uint32)
        for n in range(1, SIZES[-1] + 1):
            if len(c) < n:
                break
            h = h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :] * np.uint32(0x9E3779B1)
            if n in SIZES:
                mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                yield (mixed >> np.uint32(32 - BITS)).astype(np.int32)


def distinct_buckets(text: str) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.int32), *(np.unique(b) for b in buckets(text))]))


def sample(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, per_class: int) -> DataFrame:
    """(text, y): at most ``per_class`` documents of each label, of the training fold."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull()).groupBy(F.col(id).alias("k")).agg(F.max(label).alias("y"))
    known = known.where(~held_out("k"))
    first = [known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(per_class) for y in (0, 1)]
    ids = F.broadcast(first[0].unionByName(first[1]))  # 2 * per_class rows at most
    rows = docs.select(F.col(id).alias("k"), F.col(text).cast("string").alias("text")).join(ids, "k")
    texts = rows.where("text is not null").groupBy("text").agg(F.max("y").cast("int").alias("y"))
    # Very many rows may share an id, so the texts are bounded too.
    return written(texts.orderBy(F.xxhash64("text"), "text").limit(2 * per_class))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    having = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            having[y, distinct_buckets(text)] += 1
    at = np.flatnonzero(having.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *map(pa.array, having[:, at])], names=["bucket", "n0", "n1"])


def fit_logistic(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights by feature (scale included) and intercept. ``rows``: each document's feature numbers."""
    at = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    norm = scale / max(1.0, np.sqrt(len(at) / max(len(rows), 1)))
    x = norm[at]
    each = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    v, b = np.ones(len(scale)), 0.0
    m, s = np.zeros(len(scale) + 1), np.zeros(len(scale) + 1)
    for step in range(1, STEPS + 1):  # Adam on the whole sample
        z = np.bincount(doc, weights=x * v[at], minlength=len(rows)) + b
        off = each * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        g = np.append(np.bincount(at, weights=x * off[doc], minlength=len(scale)) + PENALTY * v / len(scale), off.sum())
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-10)
        v, b = v - move[:-1], b - move[-1]
    return v * norm, float(b)


class Model:
    def __init__(self, bucket: np.ndarray, weight: np.ndarray, intercept: float):
        self.bucket, self.weight, self.intercept = bucket, weight, intercept

    def score_column(self, text: Column) -> Column:
        bucket, weight, intercept = self.bucket, self.weight, self.intercept

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            number = np.full(1 << BITS, -1, np.int16)
            number[bucket] = np.arange(len(bucket))
            for texts in batches:
                out = []
                for part in slices(texts):
                    for t in part:
                        found = [np.zeros(0, np.int16)]
                        for b in buckets(t.decode()) if t else ():
                            f = number[b]
                            found.append(np.unique(f[f >= 0]))
                        out.append(intercept + float(weight[np.unique(np.concatenate(found))].sum()))
                yield pa.array(1 / (1 + np.exp(-np.clip(np.array(out), -40, 40))), pa.float64())

        return F.arrow_udf(tidy(run), "double").asNondeterministic()(text.cast("string"))


def train(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS
) -> Model:
    rows = sample(docs, labels, id, text, label, per_class)
    total = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n0, n1 = total.get(0, 0), total.get(1, 0)
    if not n0 or not n1:
        share = np.clip(n1 / max(n0 + n1, 1), 1e-9, 1 - 1e-9)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))))
    counts = rows.mapInArrow(tidy(_count), "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    a = F.lit(SMOOTH)
    ratio = F.log((F.col("n1") + a) / (n1 + 2 * a)) - F.log((F.col("n0") + a) / (n0 + 2 * a))
    certain = F.abs(ratio) / F.sqrt(1 / (F.col("n1") + a) + 1 / (F.col("n0") + a))
    best = counts.where(F.col("n0") + F.col("n1") >= MIN_DOCS).select("bucket", ratio.alias("ratio"), certain.alias("certain"))
    best = best.orderBy(F.desc("certain"), "bucket").limit(FEATURES).collect()
    bucket, scale = np.array([r["bucket"] for r in best], np.int64), np.array([r["ratio"] for r in best])
    number = np.full(1 << BITS, -1, np.int16)
    number[bucket] = np.arange(len(bucket))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [number[distinct_buckets(t)] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[x >= 0].tobytes() for x in f]), batch.column(1)], names=["f", "y"])

    # At most 2 * PER_CLASS rows of FEATURES two-byte numbers.
    found = rows.mapInArrow(tidy(features), "f binary, y int").collect()
    found.sort(key=lambda r: (r["y"], bytes(r["f"])))
    weight, intercept = fit_logistic([np.frombuffer(r["f"], np.int16) for r in found], np.array([r["y"] for r in found]), scale)
    return Model(bucket, weight, intercept)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out().alias("held_out"), model.score_column(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
