"""Documents to token files: five stages, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last return the columns of
documents. Quality rules drop whole documents. Near-dedup keeps one document of each group
of texts whose five-word shingles have a Jaccard similarity of 0.8 or more. Decontamination
cuts benchmark passages out of texts. Mixing repeats documents or leaves some out, by the sources' targets.
The last stage writes token files and returns one row per document in them, copies included.

Nulls, empty texts, repeated rows, empty tables and further columns are handled as each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablecheck.llm.common import table, written
from tablecheck.llm.decontaminate import remove_hits
from tablecheck.llm.mixing import mixed
from tablecheck.llm.near_copies import keep_one_copy
from tablecheck.llm.quality_rules import keep_clean
from tablecheck.llm.token_files import tokens_of


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_copy(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_hits(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens_of(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", token_files),
]

# Divergence verdicts, components and tokens are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
