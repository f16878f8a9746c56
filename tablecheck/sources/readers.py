"""Readers: datasets, training folders, rule files, landed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecheck import schemas
from tablecheck.functions.rules import Rule
from tablecheck.sources.folders import list_files

# ---- fixed values -------------------------------------------------------------------
MAX_FILE_BYTES = 500 * 1024 * 1024
CONTENT_TYPES = {"csv": "text/csv", "parquet": "application/octet-stream"}
DEFAULT_CONTENT_TYPE = "application/octet-stream"
# -------------------------------------------------------------------------------------

# quotes inside values are doubled, as spreadsheet and Python writers do
CSV = {"header": True, "escape": '"'}


def read_dataset(
    spark: SparkSession, path: str, schema: str | T.StructType | None = None, multiline: bool = False
) -> DataFrame:
    """Parquet if the path ends in .parquet, otherwise CSV with a header.

    CSV types are inferred with an extra pass unless ``schema`` is given. ``multiline`` allows
    line breaks inside quoted values, at the price of one task per file.
    """
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    reader = spark.read.options(**CSV, multiLine=multiline)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path)


def _has_files(spark: SparkSession, pattern: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return len(fs.globStatus(path) or []) > 0


def read_training_dir(spark: SparkSession, directory: str, schema: str | None = None) -> DataFrame:
    """Every .csv and .parquet file of the folder as one frame; columns are matched by name."""
    frames = []
    if _has_files(spark, f"{directory}/*.parquet"):
        frames.append(spark.read.parquet(f"{directory}/*.parquet"))
    if _has_files(spark, f"{directory}/*.csv"):
        frames.append(read_dataset(spark, f"{directory}/*.csv", schema))
    if not frames:
        raise ValueError(f"no .csv or .parquet files in {directory}")
    first, *others = frames
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of rules, from a file."""
    return spark.read.schema(schemas.RUN_RULE).json(path, multiLine=True)


def parse_rules(json_text: Column) -> Column:
    """A JSON array of rules held in a text column."""
    element = T.StructType.fromDDL(schemas.RUN_RULE)
    return F.from_json(json_text, T.ArrayType(element))


def to_rules(rules: DataFrame) -> list[Rule]:
    """Rule rows as objects that build Columns. A run's rules all become part of one plan."""
    rows = rules.collect()
    return [
        Rule(
            id=r["id"],
            name=r["name"] or "unnamed",
            category=r["type"] or "simple",
            target_fields=tuple(r["targetFields"] or ()),
            conditions=tuple(c.asDict() for c in (r["conditions"] or ())),
            parameters=dict(r["parameters"] or {}),
            scope=r["scope"] or "table",
        )
        for r in rows
    ]


def extension(name: Column) -> Column:
    base = F.lower(name)
    return F.when(base.contains("."), F.element_at(F.split(base, r"\."), -1)).otherwise("")


def content_type(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension(name)), F.lit(DEFAULT_CONTENT_TYPE))


def check_files(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Add is_valid, reason and content_type to (path, length) rows."""
    ext, size = extension(F.element_at(F.split("path", "/"), -1)), F.col("length")
    reason = (
        F.when(~ext.isin(*CONTENT_TYPES), "file type not allowed")
        .when(size > max_bytes, "file too large")
        .when(size <= 0, "file is empty")
    )
    return files.withColumns(
        {
            "is_valid": reason.isNull(),
            "reason": F.coalesce(reason, F.lit("")),
            "content_type": content_type(F.element_at(F.split("path", "/"), -1)),
        }
    )


def admit_files(spark: SparkSession, glob: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Landed files with a verdict each, empty files too. Only names and sizes are read, never the content."""
    return check_files(list_files(spark, glob), max_bytes)
