"""Session settings the operators depend on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


# The largest method, in bytes, that the JVM compiles.
COMPILED_BYTES = "8000"


def split_large_methods(spark: SparkSession) -> None:
    """Let no whole-stage method grow past what the JVM compiles; a session that sets its own limit keeps it.

    Larger methods run interpreted, up to ten times slower; Spark then uses methods split by expression.
    """
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit", "65535") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", COMPILED_BYTES)


def use_checkpoints(spark: SparkSession) -> None:
    """Point checkpoints at the shared folder the cluster names in spark.checkpoint.dir.

    Only a local session may fall back to a temporary folder.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if shared:
        if not current or shared.rstrip("/") not in current:
            sc.setCheckpointDir(shared)
    elif not current:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tablecheck-"))


def checkpointed(df: DataFrame) -> DataFrame:
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)
