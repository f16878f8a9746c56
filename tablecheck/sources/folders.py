"""Listing of folders on the executors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.operators.session import checkpointed

# Entries of a batch that a task hands on.
ENTRIES = 10_000
WILD = re.compile(r"[*?\[{]")
ENTRY = "path string, length long, is_folder boolean"


def alternatives(glob: str) -> list[str]:
    """The globs that one with {a,b} stands for."""
    found = re.search(r"\{([^{}]*)\}", glob)
    if not found:
        return [glob]
    before, after = glob[: found.start()], glob[found.end() :]
    return [x for part in found[1].split(",") for x in alternatives(before + part + after)]


def name_pattern(glob: str) -> str:
    """Regular expression for one name of a path: * and ? and [abc], [a-z], [^a]."""
    out = ""
    for token in re.findall(r"\[\^?[^\]]+\]|.", glob, re.S):
        if len(token) > 1:
            inner = token[1:-1].replace("\\", "\\\\").replace("[", "\\[")
            out += f"[{inner}]"
        else:
            out += {"*": ".*", "?": "."}.get(token) or re.escape(token)
    return f"(?s:{out})"


def _open(uri: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path in it, and what to put before its paths to make URIs of them again."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/"), "file:"
    system, path = fs.FileSystem.from_uri(quote(re.sub("^s3[an]:", "s3:", uri), safe="/:@"))
    return system, path, uri.rstrip("/").removesuffix(path.rstrip("/"))


def _entries(pattern: str | None):
    matches = re.compile(pattern).fullmatch if pattern else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Files and folders in the folders of the rows; hidden names (_x, .x) are left out, as Spark's own readers do."""
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                system, path, before = _open(folder)
                found = [
                    x for x in system.get_file_info(fs.FileSelector(path, allow_not_found=True))
                    if not x.base_name.startswith(("_", ".")) and (matches is None or matches(x.base_name))
                ]
                for at in range(0, len(found), ENTRIES):
                    part = found[at : at + ENTRIES]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([before + x.path for x in part], pa.string()),
                        pa.array([x.size or 0 if x.is_file else 0 for x in part], pa.int64()),
                        pa.array([x.type == fs.FileType.Directory for x in part], pa.bool_()),
                    ], names=["path", "length", "is_folder"])

    return run


def list_files(spark: SparkSession, glob: str) -> DataFrame:
    """path, length of the files that a glob names, and of all files in the folders that it names, empty ones included.

    Every level of folders is one job: its tasks list the folders of the level above, sizes included, and hand on rows, so
    names of files never pass through the driver. A folder is listed by one task. A file that two alternatives of a glob name is one row.
    File systems are pyarrow's (local, HDFS, S3, GCS, ABFS); a path without a scheme belongs to the session's default file system.
    """
    parts = [_list_one(spark, x) for x in alternatives(glob)]
    files = parts[0]
    for other in parts[1:]:
        files = files.union(other)
    return files if len(parts) == 1 else files.distinct()


def _qualified(spark: SparkSession, path: str) -> str:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def _list_one(spark: SparkSession, glob: str) -> DataFrame:
    names = glob.rstrip("/").split("/")
    # the last name is always matched, wild or not: it may be a file
    wild = next((i for i, x in enumerate(names) if WILD.search(x)), len(names) - 1)
    base, patterns = "/".join(names[:wild]), [name_pattern(x) for x in names[wild:]]
    if not base:
        base = "/" if glob.startswith("/") else "."
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level = spark.createDataFrame([(_qualified(spark, base),)], "path string")
    files = None
    while True:
        pattern = patterns.pop(0) if patterns else None
        found = checkpointed(level.repartition(n, "path").mapInArrow(_entries(pattern), ENTRY))
        level = found.where("is_folder").select("path")
        if not patterns:
            here = found.where(~F.col("is_folder")).select("path", "length")
            files = here if files is None else files.union(here)
        if level.isEmpty():
            none = spark.createDataFrame([], "path string, length long")
            return none if files is None else files
