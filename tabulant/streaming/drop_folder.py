"""A drop folder as a stream: files are parsed as they arrive, each batch written once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tabulant.sources.grids import GRID, _files_to_grids, decode, parse_csv


def csv_stream(spark: SparkSession, folder: str, delimiter: str = ",") -> DataFrame:
    """Grids of the CSV files that appear in ``folder``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.csv").load(folder)
    return files.select("path", "content").mapInArrow(_files_to_grids(lambda data: [(None, parse_csv(decode(data), delimiter))]), GRID)


def write_grids(grids: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends grids by batch; a batch that is run again overwrites its own folder."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return grids.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start()
