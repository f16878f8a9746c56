"""Keyed before/after comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """key, change, changed_columns. ``change``: modified, unchanged, added or removed.

    ``key`` must be unique on both sides; a null key part equals a null. Cells compare null-safe, as text
    where the two sides have different types; a column on one side only counts as changed unless it is
    null. Only the compared columns are shuffled.
    """
    shared = [c for c in before.columns if c in after.columns and c not in key]
    one_sided = [c for c in before.columns if c not in after.columns]
    one_sided += [c for c in after.columns if c not in before.columns]
    b = before.select(*key, F.struct(*[c for c in before.columns if c not in key], F.lit(True).alias("__in")).alias("b"))
    a = after.select(*key, F.struct(*[c for c in after.columns if c not in key], F.lit(True).alias("__in")).alias("a"))
    a = a.withColumnsRenamed({k: f"__a_{i}" for i, k in enumerate(key)})
    same_key = reduce(lambda x, y: x & y, [F.col(f"`{k}`").eqNullSafe(F.col(f"__a_{i}")) for i, k in enumerate(key)])
    joined = b.join(a, same_key, "full_outer").withColumns(
        {k: F.when(F.col("b.__in").isNull(), F.col(f"__a_{i}")).otherwise(F.col(f"`{k}`")) for i, k in enumerate(key)}
    )

    def differs(c: str) -> Column:
        left, right = F.col(f"b.`{c}`"), F.col(f"a.`{c}`")
        if before.schema[c].dataType != after.schema[c].dataType:
            left, right = left.cast("string"), right.cast("string")
        return ~left.eqNullSafe(right)

    tests = {c: differs(c) for c in shared}
    for c in one_sided:
        side = "b" if c in before.columns else "a"
        tests[c] = F.col(f"{side}.`{c}`").isNotNull()
    changed = F.filter(
        F.array(*[F.when(t, F.lit(c)) for c, t in tests.items()]) if tests else F.array().cast("array<string>"),
        lambda x: x.isNotNull(),
    )
    modified = reduce(lambda x, y: x | y, tests.values(), F.lit(False))
    change = (
        F.when(F.col("b.__in").isNull(), "added")
        .when(F.col("a.__in").isNull(), "removed")
        .when(modified, "modified")
        .otherwise("unchanged")
    )
    both = F.col("b.__in").isNotNull() & F.col("a.__in").isNotNull()
    return joined.select(
        *key,
        change.alias("change"),
        F.when(both, changed).otherwise(F.array().cast("array<string>")).alias("changed_columns"),
    )


def cleaning_summary(diff: DataFrame, mode: str = "keyed", same_columns: bool = True) -> DataFrame:
    """One row: total, modified, unchanged, error, output, added and removed records.

    ``mode="shape"``: if the row or column count changed, every output record counts as
    modified and the row-count difference as errors; pass ``same_columns=False`` when the
    two sides have different columns.
    """
    counts = diff.groupBy("change").count()
    of = {k: F.coalesce(F.sum(F.when(F.col("change") == k, F.col("count"))), F.lit(0)) for k in
          ("modified", "unchanged", "added", "removed")}
    one = counts.agg(*[v.alias(k) for k, v in of.items()])
    total = F.col("modified") + F.col("unchanged") + F.col("removed")
    output = F.col("modified") + F.col("unchanged") + F.col("added")
    if mode == "shape":
        same = (total == output) & F.lit(same_columns)
        modified = F.when(same, F.col("modified") + F.col("removed")).otherwise(output)
        unchanged = F.when(same, F.col("unchanged")).otherwise(F.lit(0))
        errors = F.when(same, F.lit(0)).otherwise(F.abs(total - output))
    else:
        modified, unchanged, errors = F.col("modified"), F.col("unchanged"), F.lit(0)
    return one.select(
        total.alias("total_records"),
        modified.cast("bigint").alias("modified_records"),
        unchanged.cast("bigint").alias("unchanged_records"),
        errors.cast("bigint").alias("error_records"),
        output.alias("output_records"),
        F.col("added").alias("added_records"),
        F.col("removed").alias("removed_records"),
    )
