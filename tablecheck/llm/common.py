"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.operators.session import use_checkpoints

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Lower-cases A-Z and nothing else, for bytes.
LOWER_BYTES = bytes(range(65)) + UPPER.lower().encode() + bytes(range(91, 256))
# Texts of a batch are handled in slices of about this many bytes, so memory does not follow the batch.
SLICE_BYTES = 2 << 20
# Rows of a batch that goes to Python; texts are long, and Spark's default of 10,000 is for numbers.
BATCH_ROWS = "1000"


def small_batches(spark: SparkSession) -> None:
    """Batches of BATCH_ROWS rows, unless the session sets a number of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def tidy(run: Callable) -> Callable:
    """A function over batches that gives freed memory back when it ends: Python workers are used again,
    and the memory of idle ones counts against the executor. Objects in reference cycles go, too: a few large
    ones never reach the number at which Python looks for cycles by itself."""

    @functools.wraps(run)
    def inner(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return inner


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder name inside the folder that every executor can reach."""
    use_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read again: computed once, safe from lost executors."""
    small_batches(df.sparkSession)
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if the frame has such a column already (names ignore case)."""
    small_batches(df.sparkSession)
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold that nothing is learned from: crc32 of the id as text, modulo 3, is 1."""
    fold = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1
    return F.coalesce(fold, F.lit(False))


def slices(texts: pa.Array, most: int = SLICE_BYTES):
    """Lists of the texts as UTF-8 bytes (None for null), each of about ``most`` bytes together."""
    part, size = [], 0
    for x in texts.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary()):
        b = x.as_py()
        part.append(b)
        size += len(b or b"") + 64
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def crc32_sql(digits: str) -> str:
    """DuckDB expression: the unsigned crc32 of an ASCII text, bit by bit."""
    codes = f"list_transform(string_split({digits}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    bit = "lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
    byte = f"list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), {bit})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: {byte}), 4294967295::BIGINT)"
