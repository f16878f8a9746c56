"""Previews, type inference, schema checks and dataset totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecheck.functions import scalars as S

# ---- fixed values -------------------------------------------------------------------
PREVIEW_ROWS = 100
DATE_SAMPLE = 20
DATE_SHARE = 0.8
FIELD_TYPES = ("string", "number", "date", "boolean")
# -------------------------------------------------------------------------------------


def preview(df: DataFrame, n: int = PREVIEW_ROWS, order: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows with every value as text; in file order unless ``order`` is given.

    The rows are fetched with a limit, so the scan stops after the first partitions.
    """
    head = df.orderBy(*order).limit(n) if order else df.limit(n)
    text = head.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    return df.sparkSession.createDataFrame(text.collect(), text.schema)


def preview_csv(spark: SparkSession, path: str, n: int = PREVIEW_ROWS) -> dict:
    """First rows of a CSV as text, with types inferred from those rows."""
    rows = preview(spark.read.csv(path, header=True, escape='"', inferSchema=False), n)
    inferred = infer_column_types(rows, rows.columns, scope="preview").collect()
    return {
        "rows": rows,
        "columns": rows.columns,
        "column_types": {r["column_name"]: r["inferred_type"] for r in inferred},
        "total_preview_rows": rows.count(),
    }


def preview_parquet(spark: SparkSession, path: str, n: int = PREVIEW_ROWS) -> dict:
    """First rows of a Parquet dataset as text, with type names from its schema."""
    df = spark.read.parquet(path)
    rows = preview(df, n)
    return {
        "rows": rows,
        "columns": df.columns,
        "column_types": type_names(df.schema),
        "total_preview_rows": rows.count(),
    }


def type_names(schema: T.StructType) -> dict[str, str]:
    def name(dtype: T.DataType) -> str:
        if isinstance(dtype, T.IntegralType):
            return "integer"
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            return "float"
        if isinstance(dtype, T.BooleanType):
            return "boolean"
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            return "datetime"
        return "string"

    return {f.name: name(f.dataType) for f in schema.fields}


def _value_class(v: Column) -> Column:
    """Class of a stripped value: B boolean word, D 0 or 1, I integer, F float, T date, S other,
    null when blank."""
    return (
        F.when(F.length(v) == 0, None)
        .when(v.isin("0", "1"), "D")
        .when(S.is_int_text(v), "I")
        .when(S.is_float_text(v), "F")
        .when(S.is_boolean_text(v), "B")
        .when(S.is_date_text(v), "T")
        .when(v.isNotNull(), "S")
    )


def infer_column_types(df: DataFrame, columns: Sequence[str], scope: str = "full") -> DataFrame:
    """column_name, inferred_type for text columns, in one aggregation over one scan.

    Blank values are ignored; no values gives string. In order: all boolean words or 0/1 ->
    boolean, all integers -> integer, all numbers -> float, at least 80 % dates -> date, else
    string. ``scope="preview"`` tests dates on the first 20 values of a preview frame.

    Columns become rows (place, value), so one classifier serves any number of columns, and what is
    shuffled is a row of counts for each task and column.
    """
    values = df.select(*[S.strip(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(columns)])
    if scope == "preview":
        values = values.coalesce(1)  # a preview frame is as small as its caller asked, and in order
    values = values.withColumn("row", F.monotonically_increasing_id())
    long = values.unpivot(["row"], [str(i) for i in range(len(columns))], "place", "value")
    # one empty value of each column, for frames without rows
    empty = df.sparkSession.range(0, 1, 1, 1).select(F.lit(0).cast("bigint"), F.explode(F.array(*[F.lit(str(i)) for i in range(len(columns))])), F.lit(""))
    classes = long.union(empty).select("row", "place", _value_class(F.col("value")).alias("cls"))
    cls = F.col("cls")
    aggs = [F.count(cls).alias("n"), *[F.count_if(cls == k).alias(k) for k in "BDIFT"]]
    if scope == "preview":
        seen = F.sort_array(F.collect_list(F.when(cls.isNotNull(), F.struct("row", "cls"))))
        aggs.append(F.slice(seen, 1, DATE_SAMPLE).alias("first"))
    one = classes.groupBy("place").agg(*aggs)
    n, b, d, k, f, t = (F.col(x) for x in "nBDIFT")
    dates, sampled = t, n
    if scope == "preview":
        dates, sampled = F.size(F.filter("first", lambda x: x["cls"] == "T")), F.size("first")
    kind = (
        F.when(n == 0, "string")
        .when(b + d == n, "boolean")
        .when(d + k == n, "integer")
        .when(d + k + f == n, "float")
        .when(dates >= sampled * DATE_SHARE, "date")
        .otherwise("string")
    )
    names = F.array(*[F.lit(c) for c in columns])
    return one.select(F.element_at(names, F.col("place").cast("int") + 1).alias("column_name"), kind.alias("inferred_type"))


def check_schema(df: DataFrame, template: Sequence[dict]) -> DataFrame:
    """Compare a frame with a declared template: one row per declared field.

    field_name, field_type, required, in_dataset, null_count, bad_count (present but not of
    the declared type), ok.
    """
    for f in template:
        if f["field_type"] not in FIELD_TYPES:
            raise ValueError(f"field_type must be one of {FIELD_TYPES}, got {f['field_type']!r}")
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(template):
        here = S.has_column(df, f["field_name"])
        missing = ~_has_value(df, f["field_name"]) if here else F.lit(True)
        bad = ~missing & ~_castable(df, f["field_name"], f["field_type"]) if here else F.lit(False)
        aggs += [F.count_if(missing).alias(f"m{i}"), F.count_if(bad).alias(f"b{i}")]
    one = df.agg(*aggs)
    rows = []
    for i, f in enumerate(template):
        here, required = S.has_column(df, f["field_name"]), bool(f.get("required", False))
        ok = (F.col(f"b{i}") == 0) & (F.lit(here) | F.lit(not required))
        if required:
            ok = ok & (F.col(f"m{i}") == 0)
        rows.append(
            F.struct(
                F.lit(f["field_name"]).alias("field_name"),
                F.lit(f["field_type"]).alias("field_type"),
                F.lit(required).alias("required"),
                F.lit(here).alias("in_dataset"),
                F.col(f"m{i}").alias("null_count"),
                F.col(f"b{i}").alias("bad_count"),
                ok.alias("ok"),
            )
        )
    return one.select(F.inline(F.array(*rows)))


def _has_value(df: DataFrame, name: str) -> Column:
    if isinstance(S.data_type(df, name), T.StringType):
        return F.coalesce(S.not_blank(F.col(f"`{name}`")), F.lit(False))
    return S.present(df, name)


def _castable(df: DataFrame, name: str, field_type: str) -> Column:
    c, dtype = F.col(f"`{name}`"), S.data_type(df, name)
    if field_type == "string":
        return F.lit(True)
    if field_type == "number":
        return S.to_number(df, name).isNotNull()
    if isinstance(dtype, T.StringType):
        text = S.strip(c)
        test = S.is_boolean_text(text) if field_type == "boolean" else S.is_date_text(text)
        return F.coalesce(test, F.lit(False))
    wanted = (T.BooleanType,) if field_type == "boolean" else (T.DateType, T.TimestampType, T.TimestampNTZType)
    return F.lit(isinstance(dtype, wanted))


def dataset_stats(datasets: dict[str, DataFrame]) -> DataFrame:
    """dataset, row_count, column_count for each named frame, from one count each."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("dataset"), "row_count", F.lit(len(df.columns)).cast("bigint").alias("column_count")
        )
        for name, df in datasets.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
