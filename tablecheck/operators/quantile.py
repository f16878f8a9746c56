"""Values at a rank, and percentiles, that never hold all values in one task."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000
# So few remaining values may be sorted inside one task.
SORTABLE = 50_000


class Ranked(NamedTuple):
    value: object
    following: object  # the value one rank on, None at the end
    below: int  # how many values are smaller


def _ends(values: DataFrame, fraction: float, slack: float):
    """Two values around ``fraction``; the true ends once the slack covers everything."""
    if slack >= 1.0:
        r = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
        return r["lo"], r["hi"]
    return values.agg(_cuts(fraction, slack)).first()["q"]


def _cuts(fraction: float, slack: float):
    points = [max(0.0, fraction - slack), min(1.0, fraction + slack)]
    return F.percentile_approx("v", points, ACCURACY).alias("q")


def value_at(values: DataFrame, n: int, rank: int, ends: list | None = None) -> Ranked:
    """The value at 0-based ``rank`` among the ``n`` non-null values of column ``v``, in sorted order.

    Approximate quantiles give a bracket around the rank; counts on its ends show whether an end
    holds the rank or how many values lie strictly inside, about 4 n / ACCURACY. The search goes
    on inside until that is few enough to sort. ``ends`` is a first bracket if one is known.
    """
    inside, left, below, above, slack = values, n, 0, None, 2.0 / ACCURACY
    v = F.col("v")
    while left > SORTABLE:
        at = rank - below
        lo, hi = ends or _ends(inside, at / (left - 1), slack)
        ends = None
        low, high = F.lit(lo), F.lit(hi)
        c = inside.agg(
            F.count_if(v < low).alias("lt_lo"), F.count_if(v <= low).alias("le_lo"),
            F.count_if(v < high).alias("lt_hi"), F.count_if(v <= high).alias("le_hi"),
            F.min(F.when(v > low, v)).alias("next_lo"), F.min(F.when(v > high, v)).alias("next_hi"),
        ).first()
        for value, end in ((lo, "lo"), (hi, "hi")):
            if c[f"lt_{end}"] <= at < c[f"le_{end}"]:
                beyond = c[f"next_{end}"] if c[f"next_{end}"] is not None else above
                following = value if at + 1 < c[f"le_{end}"] else beyond
                return Ranked(value, following, below + c[f"lt_{end}"])
        if c["le_lo"] <= at < c["lt_hi"]:
            inside = inside.where((v > low) & (v < high))
            below, left, above, slack = below + c["le_lo"], c["lt_hi"] - c["le_lo"], hi, 2.0 / ACCURACY
        else:  # the approximation missed the rank: look wider
            slack = min(1.0, slack * 8)
    at = rank - below
    listed = inside.agg(F.sort_array(F.collect_list("v")).alias("s"))
    found = listed.select(
        F.slice("s", at + 1, 2).alias("pair"), (F.array_position("s", F.col("s")[at]) - 1).alias("first")
    ).first()
    pair = found["pair"]
    return Ranked(pair[0], pair[1] if len(pair) > 1 else above, below + found["first"])


def exact_percentile(df: DataFrame, column: str, p: float = 95.0) -> float | None:
    """Linear-interpolated percentile over values that are neither null nor NaN, exact at any size.

    An action of a few aggregations over one column: persist ``df`` if the column is costly.
    """
    values = df.select(F.col(f"`{column}`").cast("double").alias("v"))
    values = values.where(F.col("v").isNotNull() & ~F.isnan("v"))
    first = values.agg(F.count("v").alias("n"), _cuts(p / 100.0, 2.0 / ACCURACY)).first()
    n = first["n"]
    if n == 0:
        return None
    position = (p / 100.0) * (n - 1)
    found, part = value_at(values, n, int(position), first["q"]), position - int(position)
    if part == 0 or found.following is None:
        return found.value
    return found.value + (found.following - found.value) * part


def approx_percentile(df: DataFrame, column: str, p: float = 95.0, accuracy: int = ACCURACY) -> DataFrame:
    """One row ``threshold``: the rank error is at most n / accuracy; one aggregation, no action."""
    return df.agg(F.percentile_approx(F.col(f"`{column}`"), p / 100.0, accuracy).alias("threshold"))
