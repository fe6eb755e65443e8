"""Incremental ingest: a stream of new documents runs through the batch stages, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_documents(spark: SparkSession, path: str, schema: str, delay: str = "1 hour") -> DataFrame:
    """Documents that arrive in a folder, those of equal content once within a watermark."""
    stream = spark.readStream.schema(schema).parquet(path)
    marked = stream.withColumn("arrived", F.current_timestamp()).withColumn("checksum", F.sha2("text", 256))
    return marked.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["checksum"])


def run(stream: DataFrame, stage: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Apply a batch stage to each batch and append its rows; a batch that is tried again overwrites its own folder."""

    def batch(df: DataFrame, number: int) -> None:
        stage(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
