"""Joins that stay balanced when one key holds a large share of the rows.

A key is *hot* when it owns more than 1/HOT_SHARE of all rows. There can be fewer than
HOT_SHARE such keys whatever the data size, so the table of hot keys may be broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000
SPREAD = 1024
# A hot key is not cut into pieces smaller than this.
PIECE_ROWS = 100_000
# Where both sides of a key are cut, every pair of pieces is work: rows of a piece, and of a pack at least.
GRID_ROWS = 1000
# Pairs of packs for each task, about: packs grow with the work, so what is shuffled for pairs of them does not grow with its square.
TASK_CELLS = 64
# Rows of a pack at most: what a task holds at once for one value of the other pack.
PACK_ROWS = 16_384


def hot_keys(counts: DataFrame, n: str = "n") -> DataFrame:
    """Rows of a (key..., n) table whose key is hot; fewer than HOT_SHARE rows by arithmetic."""
    total = counts.agg(F.sum(n).alias("total"))
    return counts.where(F.col(n) * HOT_SHARE > total.scalar())


def add_counts(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Add how often the row's key combination occurs; null where a key part is null.

    The counts are pre-aggregated map-side. Rows of hot keys take their count from a small
    broadcast and are spread over the shuffle by task instead of by key, as are rows with a
    null key, which match nothing.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(counts).select(*[F.col(k).alias(f"__h{i}") for i, k in enumerate(keys)], F.col("n").alias("__hot"))
    repeated = counts.where(F.col("n") > 1).select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col("n").alias("__n"),
        F.lit(0).alias("__kspread"),
    )
    any_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    scattered = F.pmod(F.spark_partition_id(), F.lit(SPREAD)) + 1
    tagged = df.join(F.broadcast(hot), _match(keys, "__h"), "left").withColumn(
        "__spread", F.when(F.col("__hot").isNotNull() | any_null, scattered).otherwise(0)
    )
    on = _match(keys, "__k") & (F.col("__spread") == F.col("__kspread"))
    count = F.when(~any_null, F.coalesce("__hot", "__n", F.lit(1)))
    joined = tagged.join(repeated, on, "left").withColumn(out, count)
    return joined.select(*df.columns, out)


def _match(keys: list[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k) == F.col(f"{prefix}{i}") for i, k in enumerate(keys)])


def _pieces(df: DataFrame, keys: list[str], out: str, rows: int | None = None) -> DataFrame:
    """The hot keys of a frame and into how many pieces of at least ``rows`` (PIECE_ROWS) rows each is cut, at most HOT_SHARE."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    by_share = F.ceil(F.col("n") * HOT_SHARE / total.scalar())
    pieces = F.least(by_share, F.ceil(F.col("n") / (rows or PIECE_ROWS))).cast("int")
    return hot_keys(counts).select(*keys, pieces.alias(out))


def _one(pieces: str) -> Column:
    return F.coalesce(pieces, F.lit(1)).cast("bigint")


def _every(pieces: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), pieces - 1))


def split_hot_join(left: DataFrame, right: DataFrame, keys: list[str], spread_by: Column) -> DataFrame:
    """Inner equi-join on ``keys`` (same names on both sides) with the left's hot keys split.

    A hot key is cut into pieces by the hash of ``spread_by`` (a left column expression unique enough to divide the
    key); the matching right rows are repeated once per piece.
    """
    hot = F.broadcast(_pieces(left, keys, "__pieces"))
    l = left.join(hot, keys, "left").withColumn("__piece", F.pmod(F.xxhash64(spread_by), _one("__pieces")))
    r = right.join(hot, keys, "left").withColumn("__piece", _every(_one("__pieces")))
    return l.drop("__pieces").join(r.drop("__pieces"), [*keys, "__piece"]).drop("__piece")


def grid_join(left: DataFrame, right: DataFrame, keys: list[str], left_by: Column, right_by: Column) -> DataFrame:
    """Inner equi-join on ``keys`` with the hot keys of either side split.

    A key with p left and q right pieces is a grid of p x q cells: a left row, in the piece of its ``left_by``, is
    repeated along its row of cells, a right row along its column, so each pair meets in one cell. The cells are dealt to
    a fixed number of tasks: adaptive execution would join small sides in one task, however many pairs they make.
    """
    rows = min(GRID_ROWS, PIECE_ROWS)
    cuts = [F.broadcast(_pieces(df, keys, name, rows)) for df, name in ((left, "__p"), (right, "__q"))]
    cell = [*keys, "__i", "__j"]

    def placed(df: DataFrame, by: Column, own: str, other: str, at: tuple[str, str]) -> DataFrame:
        cut = df.join(cuts[0], keys, "left").join(cuts[1], keys, "left")
        cut = cut.withColumn(at[0], F.pmod(F.xxhash64(by), _one(own))).withColumn(at[1], _every(_one(other)))
        return cut.drop("__p", "__q").repartition(_tasks(df), *cell)

    l = placed(left, left_by, "__p", "__q", ("__i", "__j"))
    r = placed(right, right_by, "__q", "__p", ("__j", "__i"))
    return l.join(r, cell).drop("__i", "__j")


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def pack_rows(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Rows of a pack such that all pairs of rows with equal keys are about TASK_CELLS pairs of packs for each task.

    Few large packs meet as many times as many small ones, but each is sent to fewer partners. The number is exact, so all
    uses of it cut the same packs.
    """
    count = F.count(F.lit(1)).cast("decimal(19,0)")
    both = left.groupBy(*keys).agg(count.alias("__l")).join(right.groupBy(*keys).agg(count.alias("__r")), keys)
    pairs = both.agg(F.sum(F.col("__l") * F.col("__r")).cast("double").alias("pairs")).scalar()
    rows = F.ceil(F.sqrt(pairs / (TASK_CELLS * _tasks(left))))
    return F.greatest(F.lit(GRID_ROWS), F.least(F.lit(PACK_ROWS), F.coalesce(rows, F.lit(0))))


def with_pack(df: DataFrame, keys: list[str], by: str, out: str, rows: Column) -> DataFrame:
    """Add the number of the row's pack: a key's rows are cut into packs of about ``rows`` rows by the hash of ``by``."""
    packs = F.ceil(F.col("__rows") / rows)
    return add_counts(df, keys, "__rows").withColumn(out, F.pmod(F.xxhash64(by), packs)).drop("__rows")


def packed(df: DataFrame, keys: list[str], value: str, rows: Column, pack: str = "__pack") -> DataFrame:
    """One row per key and pack (as in ``with_pack``, by the value), with the pack's values as an array."""
    members = with_pack(df.select(*keys, value), keys, value, pack, rows)
    packs = members.groupBy(*keys, pack).agg(F.collect_list(F.struct(value)).alias(value))
    return packs.withColumn(value, F.transform(value, lambda r: r[value]))


def dealt(cells: DataFrame) -> DataFrame:
    """Rows that each stand for many, evenly over the tasks: few rows of little size would else be one task."""
    return cells.repartition(_tasks(cells))


def each_pair(cells: DataFrame, left: str, right: str, item: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row for every value in the pack ``left`` with every value in the pack ``right``; the packs become the values.

    ``item`` is what becomes of a value; it is worked out for each value of a pair of packs, not for each pair of values.
    Whole-stage code holds all rows that it makes of one input row. The left pack is therefore taken apart outside of it (a
    lambda function keeps an operator out), so a task holds the rows of one left value, not those of a pair of packs.
    """
    kept = [c for c in cells.columns if c not in (left, right)]
    each = lambda pack: F.transform(pack, item or (lambda value: value))
    both = cells.withColumn(right, each(right)) if item else cells
    one = both.select(*kept, right, F.explode(each(left)).alias(left))
    return one.select(*kept, left, F.explode(right).alias(right))
