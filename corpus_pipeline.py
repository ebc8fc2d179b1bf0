"""The corpus pipeline: quality rules, exact and near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; results are written as Parquet in the shared folder and read again. Shuffle
files go with the action that wrote them, so stages do not add up on the disks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabulant.llm.common import drop_spent_shuffles, fresh_path, table
from tabulant.llm.exact_dedup import drop_exact_copies
from tabulant.llm.jaccard_join import drop_near_duplicates
from tabulant.llm.mixing import mixed
from tabulant.llm.packing import pack_documents
from tabulant.llm.quality_rules import drop_low_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    drop_spent_shuffles(spark)
    return drop_low_quality(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    drop_spent_shuffles(spark)
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, Jaccard 0.8: the smallest id of each group of linked documents stays."""
    return drop_near_duplicates(docs, n=5, p=80, q=100)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the schedule."""
    drop_spent_shuffles(spark)
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences in the order of the schedule.

    Spark reads files by size, not by name, so the written order is lost; the
    slots are derived again, which ids and sources alone decide.
    """
    drop_spent_shuffles(spark)
    return pack_documents(mixed(docs), in_order=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("ngram_jaccard_join", near),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL expresses neither the robust estimates nor the tokenizer; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = fresh_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
