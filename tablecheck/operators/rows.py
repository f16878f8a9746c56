"""Row positions and positional splits without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecheck.operators import quantile
from tablecheck.operators.session import checkpointed

_PARTITION_BITS = 33  # monotonically_increasing_id: partition number above, position below


def with_row_index(df: DataFrame, order: list[str], out: str = "row_index") -> DataFrame:
    """0-based position in the total order given by ``order`` (ties make positions arbitrary).

    The frame is range-partitioned and sorted once and checkpointed, so positions cannot
    move if a task is rerun. Per-partition row counts (one number per partition) give the
    offsets.
    """
    return _indexed(df, order, out)[0]


def _indexed(df: DataFrame, order: list[str], out: str) -> tuple[DataFrame, int]:
    spark = df.sparkSession
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = checkpointed(ordered.withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", _PARTITION_BITS)
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n")).collect()
    offset, rows = 0, []
    for r in sorted(counts, key=lambda r: r["__part"]):
        rows.append((r["__part"], offset))
        offset += r["n"]
    offsets = spark.createDataFrame(rows, "__part bigint, __offset bigint")
    position = F.col("__id").bitwiseAND(F.lit((1 << _PARTITION_BITS) - 1))
    # one row per partition of the sorted frame: bounded by the shuffle partition count
    joined = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return joined.withColumn(out, F.col("__offset") + position).select(*df.columns, out), offset


def _ranked(df: DataFrame, order: list[str]) -> bool:
    kinds = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return all(isinstance(df.schema[c].dataType, kinds) for c in order)


def rows_from(df: DataFrame, order: list[str], start: int) -> DataFrame | None:
    """The rows from position ``start`` on, as a filter; None if that needs row positions."""
    if start <= 0:
        return df
    before = _before_rank(df, order, start) if _ranked(df, order) else None
    return None if before is None else df.where(~before)


def split_ordered(df: DataFrame, order: list[str], share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """First floor(share * n) rows in order, and the rest.

    Where the order columns are numbers or times, the key of the first row of the rest is
    searched column by column and both parts are plain filters: nothing is sorted or moved.
    Text columns, or rows that tie on the whole key at the cut, need row positions.
    """
    if _ranked(df, order):
        before = _before_rank(df, order, int(df.count() * share))
        if before is not None:
            return df.where(before), df.where(~before)
    indexed, n = _indexed(df, order, "__row")
    cut = int(n * share)
    head = indexed.where(F.col("__row") < cut).drop("__row")
    tail = indexed.where(F.col("__row") >= cut).drop("__row")
    return head, tail


def _before_rank(df: DataFrame, order: list[str], rank: int) -> Column | None:
    """The predicate that holds for exactly the first ``rank`` rows in order (nulls first).

    None if rows that tie on the whole key lie on both sides of the cut.
    """
    before, tied, subset = F.lit(False), F.lit(True), df.select(*order)
    for i, name in enumerate(order):
        c = F.col(f"`{name}`")
        sizes = subset.agg(F.count(F.lit(1)).alias("n"), F.count(c).alias("filled")).first()
        if rank >= sizes["n"]:
            return before | tied
        if sizes["n"] <= quantile.SORTABLE:
            rest = _before_key(subset, order[i:], rank)
            return None if rest is None else before | (tied & rest)
        nulls = sizes["n"] - sizes["filled"]
        if rank < nulls:
            subset, tied = subset.where(c.isNull()), tied & c.isNull()
            continue
        values = subset.select(c.alias("v")).where(c.isNotNull())
        found = quantile.value_at(values, sizes["filled"], rank - nulls)
        value = F.lit(found.value)
        before = before | (tied & (c.isNull() | (c < value)))
        rank -= nulls + found.below
        subset, tied = subset.where(c == value), tied & c.isNotNull() & (c == value)
    return before if rank == 0 else None


def _before_key(few: DataFrame, order: list[str], rank: int) -> Column | None:
    """``_before_rank`` for at most SORTABLE rows: their keys are sorted in one task."""
    keys = few.agg(F.sort_array(F.collect_list(F.struct(*order))).alias("s"))
    cut = keys.select(
        F.col("s")[rank].alias("key"),
        (F.lit(rank > 0) & F.col("s")[max(rank - 1, 0)].eqNullSafe(F.col("s")[rank])).alias("tie"),
    ).first()
    if cut["tie"]:
        return None
    before, tied = F.lit(False), F.lit(True)
    for name in order:
        c, value = F.col(f"`{name}`"), F.lit(cut["key"][name]).cast(few.schema[name].dataType)
        smaller = value.isNotNull() & (c.isNull() | F.coalesce(c < value, F.lit(False)))
        before, tied = before | (tied & smaller), tied & c.eqNullSafe(value)
    return before
