"""Storage that the planner knows: tables in buckets of a key, which join without a shuffle, and in partitions, which are pruned."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def store_bucketed(df: DataFrame, keys: Sequence[str], buckets: int, name: str | None = None, partition_by: Sequence[str] = ()) -> str:
    """Stores a table in ``buckets`` by the hash of ``keys``, sorted in each, so that tables of the same keys and number meet bucket by bucket.

    Rows are dealt by bucket first, so that a bucket is one file, and a join of two such tables doesn't sort either. The
    number is for the table's final size: at 128 MB a file a terabyte wants 8,192. Returns the name; a table that got none is dropped
    when the driver ends.
    """
    spark = df.sparkSession
    if name is None:
        name = f"stored_{uuid.uuid4().hex}"
        atexit.register(_drop, spark, name)
    # a hash of the same kind as the buckets', so that each task writes whole buckets
    writer = df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)
    return name


def _drop(spark: SparkSession, name: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # noqa: BLE001  the gateway may be gone at exit
        pass
