"""Pages as they arrive: every operator stays within a page, so a micro-batch of
files is a batch of pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """New files of a folder as (page_id, path, content)."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).load(path)
    return files.select(F.xxhash64("path").alias("page_id"), "path", "content")


def process(stream: DataFrame, work: Callable[[DataFrame], DataFrame], to: str, checkpoint: str):
    """Applies a batch plan to every micro-batch and writes its rows once: each
    batch has a folder of its own, which a repeat overwrites."""

    def write(batch: DataFrame, batch_id: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{to}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
