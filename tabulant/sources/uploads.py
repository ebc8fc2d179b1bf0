"""A folder of uploads of any kind: grids of what can be read, and a row with the reason for what cannot.

Files are dispatched by extension. A file that fails, or that no reader is for, is
a row with an error; the job and the other files go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulant.operators import detect
from tabulant.sources.csv_splits import read_csv
from tabulant.sources.grids import decode, kind_of_file, parse_html_table, parse_xlsx

Sheets = list[tuple[str | None, list[list[str]]]]
Reader = Callable[[bytes], Sheets]

#: What the reference data calls a file that nothing reads.
UNSUPPORTED = "不支持的文件格式"
_CSV_GLOB = "*.[cC][sS][vV]"
_ENTRY = "path string, kind string, sheet string, row_idx long, cells array<string>, error string"
_TYPES = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.string())


def parse_workbook(data: bytes) -> Sheets:
    """S3: a workbook by its content: a zipped one, or a web page that is named like one."""
    if data[:2] == b"PK":
        return parse_xlsx(data)
    text = decode(data[:4096]).lower()
    if "<table" in text or "<html" in text:
        return [(None, parse_html_table(decode(data)))]
    raise ValueError("neither a zipped workbook nor a web page")


READERS: dict[str, Reader] = {"excel": parse_workbook}


def _parsing(readers: dict[str, Reader]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, kind, content in zip(batch.column("path").to_pylist(), batch.column("kind").to_pylist(), batch.column("content")):
                rows: list[tuple] = []
                try:
                    for sheet, grid in readers[kind](content.as_py()):
                        rows += [(path, kind, sheet, i, r, None) for i, r in enumerate(grid)] or [(path, kind, sheet, None, None, None)]
                except Exception as e:  # whatever a damaged file makes its reader raise is that file's reason
                    rows = [(path, kind, None, None, None, f"{type(e).__name__}: {e}")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), _TYPES)], names=[f.split()[0] for f in _ENTRY.split(", ")])

    return run


def read_uploads(spark: SparkSession, folder: str, readers: dict[str, Reader] | None = None) -> DataFrame:
    """(path, kind, sheet, source_id, row_idx, cells, error) of every file in ``folder``.

    A good source has its rows and no error; an empty one has a row without
    ``row_idx``. A bad file has one row with its reason. Files without a single
    byte are not scanned by Spark and are in no output. CSV files are split among tasks; other files are read whole, by one task each. ``readers`` adds
    readers by kind (``excel``, ``pdf``, ``image``): bytes to sheets of rows.
    """
    known = READERS | (readers or {})
    files = spark.read.format("binaryFile").load(folder).select("path", kind_of_file(F.col("path")).alias("kind"))
    csv = files.where("kind = 'csv'").select("path", "kind")
    grids = read_csv(spark, folder, glob=_CSV_GLOB) if csv.limit(1).count() else None
    out = files.where(F.col("kind").isNull() | ~F.col("kind").isin("csv", *known)).select("path", "kind", F.lit(None).cast("string").alias("sheet"), F.lit(None).cast("long").alias("row_idx"), F.lit(None).cast("array<string>").alias("cells"), F.lit(UNSUPPORTED).alias("error"))
    whole = spark.read.format("binaryFile").option("pathGlobFilter", "*[!vV]").load(folder).select("path", "content", kind_of_file(F.col("path")).alias("kind"))
    out = out.unionByName(whole.where(F.col("kind").isin(*known)).mapInArrow(_parsing(known), _ENTRY))
    if grids is not None:
        rows = csv.join(grids.withColumnRenamed("source_id", "_path"), _plain(F.col("path")) == _plain(F.col("_path")), "left")
        out = out.unionByName(rows.select("path", "kind", F.lit(None).cast("string").alias("sheet"), "row_idx", "cells", F.lit(None).cast("string").alias("error")))
    name = F.when(F.col("sheet").isNull(), F.col("path")).otherwise(F.concat("path", F.lit("#"), "sheet"))
    return out.withColumn("source_id", name)


def _plain(path):
    """The two readers write the same path as ``file:/x`` and ``file:///x``, one of them with escapes."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^([a-z0-9]+):/+", "$1:/")


def grids_of(entries: DataFrame) -> DataFrame:
    return entries.where("error is null and row_idx is not null").select("source_id", "row_idx", "cells")


def failures_of(entries: DataFrame) -> DataFrame:
    """(path, reason) of the files that gave nothing."""
    return entries.where("error is not null").select("path", F.col("error").alias("reason"))


def write_uploads(entries: DataFrame, out: str) -> tuple[DataFrame, DataFrame]:
    """Both outputs from one pass over the files: written once, parted by whether they failed; (grids, failures)."""
    entries.withColumn("failed", F.col("error").isNotNull()).write.partitionBy("failed").parquet(out)
    written = entries.sparkSession.read.schema(entries.withColumn("failed", F.lit(True)).schema).parquet(out)
    return grids_of(written.where("not failed")), failures_of(written.where("failed"))


def source_records(entries: DataFrame) -> DataFrame:
    """One row per source that was read: source_id, kind, file_name, sheet, selected, n_rows, header_row, data_rows.

    A source without a cell that says anything has no header row and no data rows, and is a source all the same.
    """
    good = entries.where("error is null")
    file_name = F.regexp_extract("path", r"([^/\\]*)\z", 1)
    sources = good.groupBy("source_id", "kind", file_name.alias("file_name"), "sheet").agg(F.count("row_idx").alias("n_rows"))
    tables, rows = detect.detect_tables(grids_of(entries))
    found = tables.select("source_id", "header_row").join(rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("data_rows")), "source_id", "left")
    return sources.join(found, "source_id", "left").select("source_id", "kind", "file_name", "sheet", F.lit(True).alias("selected"), "n_rows", "header_row", F.coalesce("data_rows", F.lit(0)).alias("data_rows"))
