"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all contracts: space and \t \n \v \f \r.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can see.

    It is read from ``spark.checkpoint.dir``; only where that is unset and Spark
    runs in one process (tests) a temporary folder is made and remembered in the
    session. On a cluster an unset folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tabulant.shared.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.tabulant.shared.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def drop_spent_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of an action when it ends, not when the driver next collects garbage.

    An action that would read them again runs its stages anew.
    """
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage in a way that survives lost executors, and gives the
    planner the true size of the table (so small ones are broadcast by Spark's
    own threshold and large ones are not). Shuffle files of the step go with it.
    """
    drop_spent_shuffles(df.sparkSession)
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Deletes what ``materialise`` wrote, once nothing reads it any more; other frames are left alone."""
    for table in tables:
        path = _PATHS.pop(table, None)
        if path:
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also inside nested lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def compact(texts: pa.Array) -> pa.Array:
    """The same strings in buffers of their own: some string kernels misread slices."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())


def text_parts(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``most`` bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    first = total = 0
    for i, n in enumerate(sizes):
        if i > first and total + n > most:
            yield batch.take(pa.array(np.arange(first, i)))
            first, total = i, 0
        total += int(n)
    if len(sizes) > first:
        yield batch.take(pa.array(np.arange(first, len(sizes))))


def lowered(texts: pa.Array) -> pa.Array:
    """A-Z lower-cased; null is empty."""
    return pc.ascii_lower(pc.fill_null(compact(texts), ""))


def word_codes(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text (null: none), dictionary-coded.

    Returns (distinct words, code of every word in order, offsets by text).
    """
    split = pc.ascii_split_whitespace(pc.fill_null(compact(texts), ""))
    flat, offsets = split.flatten(), split.offsets.to_numpy()
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    coded = flat.filter(full).dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), kept[offsets].astype(np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser (splitmix64), elementwise on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
