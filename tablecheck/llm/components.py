"""Connected components of links between keys, as joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecheck.llm.common import tidy, written
from tablecheck.operators.skew import HOT_SHARE, PIECE_ROWS, split_hot_join

# Links that a task connects at a time.
FOREST = 1 << 20


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars that connect what the links (a, b) connect: every key but the smallest of its component, and that smallest."""
    keys, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(keys))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            own = np.flatnonzero(root != np.arange(len(keys)))
            return keys[own], keys[root[own]]
        root = new


def _forest(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def stars() -> pa.RecordBatch:
            sides = [np.concatenate([h[k] for h in held]) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in spanning(*sides)], names=["a", "b"])

        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += len(batch)
            if size >= most:
                yield stars()
                held, size = [], 0
        if held:
            yield stars()

    return run


def _forests(edges: DataFrame, most: int) -> DataFrame:
    """The links with those of each task replaced by stars, FOREST links at a time."""
    return written(edges.mapInArrow(tidy(_forest(most)), "a long, b long"))


def _to_least(edges: DataFrame, least: DataFrame, hot: bool) -> DataFrame:
    """(b, m) for the links (a, b) and the table (a, m)."""
    if hot:
        return split_hot_join(edges, least, ["a"], F.col("b")).select("b", "m")
    return edges.join(least, "a").select("b", "m")


def _hot(counts: DataFrame) -> bool:
    """Whether a key of the table (a, n) has so many links that its rows are cut into pieces."""
    row = counts.agg(F.sum("n").alias("total"), F.max("n").alias("most")).first()
    return row["most"] is not None and row["most"] > PIECE_ROWS and row["most"] * HOT_SHARE > row["total"]


def components(edges: DataFrame, forest: int = FOREST) -> DataFrame:
    """(a, b): every linked key but the smallest of its component, and that smallest key, each once.

    ``edges`` has two columns of type long; loops and links to null are ignored. In a round every larger neighbour of a
    key is linked to the smallest of the key and its neighbours, and then every smaller neighbour of a key, and the key, to
    the smallest of them; each half is one pre-aggregated grouping and one join on the key, whose hot keys are cut into
    pieces. Tasks connect what they hold before a round, ``forest`` links at a time. It ends when all components
    are stars, which the grouping of the next round shows.
    """
    now = _forests(edges.toDF("a", "b").where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")), forest)
    while True:
        both = now.union(now.select("b", "a")).toDF("a", "b")
        below = F.when(F.col("b") < F.col("a"), F.col("b"))
        stats = both.groupBy("a").agg(
            F.min("b").alias("x"), F.max("b").alias("y"), F.max(below).alias("last"), F.count(F.lit(1)).alias("n")
        )
        stats = written(stats.withColumn("m", F.least("a", "x")))
        is_open = F.col("m").eqNullSafe(F.col("x")) & ((F.col("last") > F.col("x")) | (F.col("y") > F.col("a")))
        if stats.where(is_open).isEmpty():
            return stats.where("m < a").select("a", F.col("m").alias("b"))
        large = written(_to_least(both.where("b > a"), stats.select("a", "m"), _hot(stats)).toDF("a", "b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = written(down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
        small = _to_least(down, least.select("a", "m"), _hot(least)).toDF("a", "b").where("a <> b")
        now = _forests(small.union(least.select("a", F.col("m").alias("b"))), forest)
