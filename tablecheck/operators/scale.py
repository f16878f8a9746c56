"""Numeric columns, their scaling, and scaled features as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecheck.functions import scalars as S


def numeric_columns(df: DataFrame) -> list[str]:
    found = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    if not found:
        raise ValueError("no numeric columns found")
    return found


def scaler_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, mean, std (population; 1 where it is 0) in one aggregation."""
    aggs = []
    for i, c in enumerate(columns):
        v = S.to_number(df, c)
        aggs += [F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}")]
    one = df.agg(*aggs)
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"m{i}").alias("mean"),
            F.when(F.col(f"s{i}") == 0, 1.0).otherwise(F.col(f"s{i}")).alias("std"),
        )
        for i, c in enumerate(columns)
    ]
    return one.select(F.inline(F.array(*rows)))


def scaled(df: DataFrame, column: str, mean: float, std: float, clip: tuple[float, float] | None) -> Column:
    """(x - mean) / std, clipped; a missing value becomes the mean."""
    z = (F.coalesce(S.to_number(df, column), F.lit(mean)) - F.lit(mean)) / F.lit(std)
    return z if clip is None else F.least(F.greatest(z, F.lit(float(clip[0]))), F.lit(float(clip[1])))


def scale_clip(
    df: DataFrame, stats: list, clip: tuple[float, float] | None = (0.0, 1.0), keep: list[str] | None = None
) -> DataFrame:
    """Scale the columns named in ``stats`` (collected ``scaler_stats`` rows, one per column)."""
    features = [
        scaled(df, r["column_name"], r["mean"], r["std"], clip).alias(f"z{i}") for i, r in enumerate(stats)
    ]
    return df.select(*(keep or []), *features)
