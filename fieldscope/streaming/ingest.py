"""Incremental ingest and validation (T1-T3) with Structured Streaming.

Documents are self-contained, so there is no watermark or state: each micro
batch is validated (or compared) in ``foreachBatch`` and written to a table
partitioned by batch id with dynamic partition overwrite, which makes a
replayed batch idempotent. Progress lives in the checkpoint folder, which
is the cluster's shared ``spark.checkpoint.dir`` (or a folder under it).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import BINARY_FILE_SCHEMA


def folder_stream(spark: SparkSession, root: str, glob: str = "*.json", max_files: int = 50) -> DataFrame:
    """New JSON files under ``root`` in bounded micro batches."""
    return (
        spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
        .option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", max_files).load(root)
    )


def parquet_stream(spark: SparkSession, root: str, schema, max_files: int = 1) -> DataFrame:
    """T3 source: a growing folder of Parquet document tables."""
    return spark.readStream.format("parquet").schema(schema).option("maxFilesPerTrigger", max_files).load(root)


def run_batches(stream: DataFrame, fn: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
                available_now: bool = True) -> None:
    """Apply ``fn`` to each micro batch and write it under
    ``out/batch_id=<n>``; with ``available_now`` the call returns once all
    input present at start has been processed."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        res = fn(batch).withColumn("batch_id", F.lit(batch_id))
        (res.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(out))

    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    q = w.start()
    if available_now:
        q.awaitTermination()
