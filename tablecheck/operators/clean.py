"""Cleaning steps as DataFrame transforms."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecheck.functions import scalars as S

Step = Callable[[DataFrame], DataFrame]
FILL = "Unknown"


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Whole-row duplicates. Copies collapse map-side, so a much-copied row is no hot key."""
    return df.dropDuplicates()


def normalize_text(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, S.strip(F.lower(F.col(f"`{column}`"))))


def fill_nulls(df: DataFrame, column: str, value: object = None) -> DataFrame:
    """Fill missing values; the column keeps its type. Text is filled with FILL if no value is given."""
    dtype = S.data_type(df, column)
    if value is None:
        if not isinstance(dtype, T.StringType):
            raise ValueError(f"give a value to fill {column} with, a {dtype.simpleString()} column")
        value = FILL
    filled = F.lit(value) if isinstance(dtype, T.StringType) else F.lit(value).cast(dtype)
    return df.withColumn(column, F.when(S.present(df, column), F.col(f"`{column}`")).otherwise(filled))


def drop_out_of_range(df: DataFrame, column: str, lo: float, hi: float) -> DataFrame:
    """Keep lo <= value <= hi; missing values are dropped."""
    return df.where(S.present(df, column) & F.col(f"`{column}`").between(lo, hi))


def row_local(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | None = None) -> DataFrame:
    """Pandas cleaning code that looks at one row at a time, run over Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema or df.schema)


STEPS: dict[str, Callable] = {
    "drop_duplicate_rows": drop_duplicate_rows,
    "normalize_text": normalize_text,
    "fill_nulls": fill_nulls,
    "drop_out_of_range": drop_out_of_range,
}

# Issue wording -> step; the rest of the issue names the column.
_ISSUES = (
    (re.compile(r"duplicate", re.I), "drop_duplicate_rows"),
    (re.compile(r"(?:missing values?|nulls?) in (?P<column>\w+)", re.I), "fill_nulls"),
    (re.compile(r"(?:inconsistent|format|text|case).* in (?P<column>\w+)", re.I), "normalize_text"),
    (re.compile(r"(?:outliers?|out of range).* in (?P<column>\w+)", re.I), "drop_out_of_range"),
)


def plan_steps(issues: Sequence[str], parameters: dict[str, dict] | None = None) -> list[tuple[str, dict]]:
    """Issue texts to ordered steps. ``parameters`` gives per-column arguments: a fill ``value``,
    ``lo`` and ``hi``. Rows are only dropped where a range is given for the column; only text has a
    fill value of its own."""
    parameters = parameters or {}
    steps: list[tuple[str, dict]] = []
    for issue in issues:
        for pattern, step in _ISSUES:
            m = pattern.search(issue)
            if not m:
                continue
            column = m.groupdict().get("column")
            given = parameters.get(column, {}) if column else {}
            if step == "drop_duplicate_rows":
                steps.append((step, {}))
            elif step == "fill_nulls":
                steps.append((step, {"column": column, "value": given.get("value")}))
            elif step == "drop_out_of_range":
                if {"lo", "hi"} <= given.keys():
                    steps.append((step, {"column": column, "lo": given["lo"], "hi": given["hi"]}))
            else:
                steps.append((step, {"column": column}))
            break
        else:
            raise ValueError(f"no cleaning step for issue {issue!r}")
    return steps


def compile_steps(steps: Sequence[tuple[str, dict]]) -> list[Step]:
    unknown = [name for name, _ in steps if name not in STEPS]
    if unknown:
        raise ValueError(f"unknown cleaning steps {unknown}")
    return [partial(STEPS[name], **args) for name, args in steps]


def clean(df: DataFrame, fns: Sequence[Step] | Step) -> DataFrame:
    """Apply user functions ``df -> df`` in order; each must return a DataFrame."""
    for fn in [fns] if callable(fns) else fns:
        df = df.transform(fn)
        if not isinstance(df, DataFrame):
            raise TypeError("a cleaning function must return a DataFrame")
    return df
