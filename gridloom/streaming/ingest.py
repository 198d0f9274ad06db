"""Directories of workbooks as a stream: each new file's cells are written once, cleaned or not."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.datasource import read_cells


def stream_cells(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """A stream of the cells of all workbooks that appear under path."""
    files = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", max_files).schema("path string, modificationTime timestamp, length bigint, content binary").load(path)
    return read_cells(files.where(F.hex(F.substring("content", 1, 4)) == "504B0304"))


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str, clean: Callable[[DataFrame], DataFrame] | None = None, available_now: bool = True) -> StreamingQuery:
    """Writes the cells of new workbooks to Parquet under out; clean, if given, works on each batch's cells. Files that the
    checkpoint knows aren't read again, and a batch that is repeated overwrites its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        (clean(batch) if clean else batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream_cells(spark, path).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()
