"""The folder that all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_local_scratch: list[str] = []
_made: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a temporary one only for local masters."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local_scratch:
        _local_scratch.append(tempfile.mkdtemp(prefix="evidra-"))
    return _local_scratch[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    _made.append(f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def drop_scratch(spark: SparkSession) -> None:
    """Delete what operators have written to the shared folder; for use once their results are saved."""
    while _made:
        drop_path(spark, _made.pop())


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a Parquet table in the shared folder: lineage ends there, and what is
    read more than once is computed once. A lost executor costs no more than the reading task."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_BATCH_ROWS)
    spark.conf.set(_BATCH_ROWS, str(min(int(before), 1000) if int(before) > 0 else 1000))  # texts are long: small batches
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
