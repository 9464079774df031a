"""The stateless functions on documents, applied to streams of files by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc (the file's path), text: a stream of whole files."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    return raw.select(F.col("path").alias("doc"), F.decode("content", "UTF-8").alias("text"))


def each_batch(stream: DataFrame, function: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """function's rows of every micro-batch, written under target/batch=n. A batch that runs twice overwrites its own folder, so no row appears twice."""

    def write(batch: DataFrame, n: int) -> None:
        function(batch).write.mode("overwrite").parquet(f"{target}/batch={n}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
