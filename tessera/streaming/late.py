"""Streams whose state ends: append mode behind a watermark, deduplication within it, and changed rows by version.

A source is a folder that files are added to. Each run takes the files that have come since, in micro-batches, from where the
checkpoint says that the run before stopped, and ends. What a run keeps is bounded by the time that it waits for late rows;
rows that come later than that are dropped and counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.time import bucket_window


def added_files(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; without a bound all that is new is one micro-batch."""
    reader = spark.readStream.schema(schema)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(path)


def closed_buckets(stream: DataFrame, ts: str, width: str, keys: Sequence[str], aggregates: Sequence[Column], late: str) -> DataFrame:
    """(bucket, keys, aggregates), for append mode: a bucket comes out once, when the watermark, the greatest time of earlier
    micro-batches less ``late``, has reached its end; then its state goes, and rows that still come for it are dropped."""
    timed = stream.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    counted = timed.groupBy(bucket_window(width, "_at").alias("_window"), *keys).agg(*aggregates)
    return counted.select(F.col("_window.start").cast("timestamp_ntz").alias("bucket"), *(c for c in counted.columns if c != "_window"))


def first_deliveries(stream: DataFrame, ids: Sequence[str], ts: str, late: str) -> DataFrame:
    """Rows whose ``ids`` haven't come before, for streams that deliver a row more than once with the same time. An id is
    remembered until the watermark is ``late`` beyond its time; rows behind the watermark are dropped, so none comes out twice."""
    timed = stream.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    return timed.dropDuplicatesWithinWatermark(list(ids)).drop("_at")


def append_to_files(result: DataFrame, path: str, checkpoint: str) -> list[dict]:
    """Runs a stream in append mode over what is new, into Parquet files that hold each row once even if a run is broken off; returns
    the progress of its micro-batches."""
    return _run(result.writeStream.format("parquet").option("path", path).outputMode("append"), checkpoint)


def upsert_versions(result: DataFrame, path: str, checkpoint: str) -> list[dict]:
    """Runs a stream in update mode over what is new: the rows that each micro-batch has changed are a version in the folder.
    A micro-batch that is done again replaces its own version."""

    def store(batch: DataFrame, version: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={version}")

    return _run(result.writeStream.foreachBatch(store).outputMode("update"), checkpoint)


def latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The last version of each key's row."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "version")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "version").alias("_v"))
    return last.select(*keys, "_v.*")


def compact_versions(spark: SparkSession, path: str, keys: Sequence[str], to: str) -> None:
    """Writes the last versions as version 0 of a new folder, which then has a row for each key."""
    latest(spark, path, keys).write.mode("overwrite").parquet(f"{to}/version=0")


def _run(writer, checkpoint: str) -> list[dict]:
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return list(query.recentProgress)


def dropped_rows(progress: Sequence[dict]) -> int:
    """Rows, or for aggregates partial sums of rows, that came behind the watermark in these micro-batches."""
    return sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"])
