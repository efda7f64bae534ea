"""Continuous aggregates kept by Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.time import bucket_window


def stream_table(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A growing folder of Parquet files, or one file, as a stream; its schema is that of the files there now."""
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and not _is_folder(spark, path) else reader.parquet(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()


def bucketed(stream: DataFrame, ts: str, width: str, keys: Sequence[str], aggregates: Sequence[Column], late: str) -> DataFrame:
    """The aggregate of a stream, which waits ``late`` for rows that come late; state older than that is dropped."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    counted = timed.groupBy(bucket_window(width, ts).alias("_window"), *keys).agg(*aggregates)
    return counted.select(F.col("_window.start").alias("bucket"), *(c for c in counted.columns if c != "_window"))


def run_available(stream: DataFrame, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over what there is, and returns the result table as a DataFrame."""
    spark = stream.sparkSession
    name = f"tessera_{uuid.uuid4().hex}"
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start().awaitTermination()
    return spark.table(name)


def refresh_by_batch(stream: DataFrame, store, checkpoint: str) -> None:
    """Upserts changed buckets: each batch hands (changed buckets, batch id) to ``store``, which overwrites their days."""
    query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(store).start()
    query.awaitTermination()
