"""Exact deduplication by skew-safe combining.

Texts are equal when identical after every run of white space has become one
space. Equal texts meet in three steps, each of which groups by the digest AND
the full normalised text, so a digest collision never joins two texts:

1. locally: Spark's partial aggregate keeps one row per text and task;
2. by (digest, salt): the salt is the task's number modulo ``salts``, so the
   copies of one hot text that many tasks hold meet in up to ``salts`` places;
3. by digest: at most ``salts`` winners per text are left to combine.

Only then are the rows looked up again, by digest and on light rows; that join
has two plain exchanges, so adaptive execution splits a hot digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulant.llm.common import materialise

#: A run that is not already one space; replacing these is replacing every run.
_RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUN, " ")


def _classes(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    rows = docs.select(
        F.col(id_col).alias("_id"),
        normalised(F.col(text_col)).alias("_norm"),
        (F.spark_partition_id() % F.lit(salts)).alias("_salt"),
    ).withColumn("_sha", F.sha2("_norm", 256))
    salted = rows.groupBy("_sha", "_norm", "_salt").agg(F.min("_id").alias("_id"), F.count(F.lit(1)).alias("_n"))
    return salted.groupBy("_sha", "_norm").agg(F.min("_id").alias("keep_id"), F.sum("_n").alias("group_size"))


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.withColumn("_norm", normalised(F.col(text_col))).withColumn("_sha", F.sha2("_norm", 256))


def _classes_and_keys(docs: DataFrame, id_col: str, text_col: str, salts: int) -> tuple[DataFrame, list[str]]:
    """The classes, and the columns that tell them apart: the digest unless two texts share one."""
    every = _classes(docs, id_col, text_col, salts)
    light = materialise(every.select("_sha", "keep_id", "group_size"), "exact-classes")
    if light.groupBy("_sha").count().where("count > 1").isEmpty():
        return light, ["_sha"]
    return every, ["_sha", "_norm"]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty. Of equal texts the row with the smallest id
    stays; a null id stays only where all ids of its group are null. Rows that
    repeat the id as well as the text are one row given twice: all are marked
    kept here, and ``drop_exact_copies`` leaves one. An empty table gives an
    empty result.
    """
    classes, keys = _classes_and_keys(docs, id_col, text_col, salts)
    rows = _keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), "_text").select("doc_id", *keys)
    return rows.join(classes, keys).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group of equal texts.

    The winners are joined by (digest, id), so no key is hot.
    """
    classes, keys = _classes_and_keys(docs, id_col, text_col, salts)
    renamed = {c: f"_in_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in renamed.items()])
    rows = _keyed(rows, renamed[text_col]).drop(*({"_norm"} - set(keys)))
    won = classes.select(*[F.col(k).alias(f"w{k}") for k in keys], "keep_id")
    same = F.col(renamed[id_col]).eqNullSafe(F.col("keep_id"))
    for k in keys:
        same &= F.col(k) == F.col(f"w{k}")
    kept = rows.join(won, same, "left_semi").dropDuplicates([*keys, renamed[id_col]])
    return kept.select(*[F.col(n).alias(c) for c, n in renamed.items()])
