"""Time-partitioned tables and continuous aggregates: chunks, retention, layout, refresh, real-time union, rollup."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.time import minus, plus, time_bucket


def with_chunk(df: DataFrame, ts: str, interval: str) -> DataFrame:
    """Adds the start of the chunk that each row lies in, the column a time-partitioned table is written by."""
    return df.withColumn("chunk", time_bucket(interval, ts))


def with_space(df: DataFrame, column: str, n: int) -> DataFrame:
    """Adds the space partition of each row: a hash of ``column`` into ``n`` parts."""
    return df.withColumn("space", F.pmod(F.xxhash64(column), F.lit(n)).cast("int"))


def write_chunks(df: DataFrame, path: str, ts: str, interval: str, segment_by: Sequence[str] = (), order_by: Sequence[str] = ()) -> None:
    """Writes a table partitioned by chunk, laid out for compression: rows of a segment together, in order.

    Rows are dealt by chunk and segment, so a chunk is written by as many tasks as it has segments and no chunk waits for one.
    """
    laid = with_chunk(df, ts, interval)
    laid = laid.repartition("chunk", *segment_by).sortWithinPartitions("chunk", *segment_by, *order_by)
    laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(path)


def compressed_layout(df: DataFrame, segment_by: Sequence[str], order_by: Sequence[Column | str]) -> DataFrame:
    """The rows, placed as compression wants them: by segment, in order inside. The result is the same set of rows."""
    return df.repartition(*segment_by).sortWithinPartitions(*segment_by, *order_by)


def retained(df: DataFrame, ts: str, drop_after: str, as_of: Column, chunk_interval: str | None = None) -> DataFrame:
    """Rows not older than ``drop_after`` at ``as_of``; with a chunk interval whole chunks go, once all of one is older."""
    bound = minus(as_of, drop_after)
    if chunk_interval is None:
        return df.filter(F.col(ts) >= bound)
    return df.filter(F.col(ts) >= time_bucket(chunk_interval, bound))  # the same as comparing chunks, and the scan knows the column


@dataclass(frozen=True)
class ContinuousAggregate:
    """An aggregate over time buckets that can be stored, refreshed in part, rolled up, and read with its fresh tail."""

    ts: str
    width: str
    keys: tuple[str, ...]
    aggregates: tuple[Column, ...]

    def query(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(time_bucket(self.width, self.ts).alias("bucket"), *self.keys).agg(*self.aggregates)

    def refresh(self, stored: DataFrame, rows: DataFrame, start: Column, end: Column) -> DataFrame:
        """``stored`` with all buckets that lie whole in ``[start, end)`` computed anew; the filters reach the scan."""
        low, high = self._window(start, end)
        fresh = self.query(rows.filter((F.col(self.ts) >= low) & (F.col(self.ts) < high)))
        return stored.filter((F.col("bucket") < low) | (F.col("bucket") >= high)).unionByName(fresh)

    def window_rows(self, rows: DataFrame, start: Column, end: Column) -> DataFrame:
        """The aggregate of the buckets that a refresh of ``[start, end)`` would compute."""
        low, high = self._window(start, end)
        return self.query(rows.filter((F.col(self.ts) >= low) & (F.col(self.ts) < high)))

    def _window(self, start: Column, end: Column) -> tuple[Column, Column]:
        first = time_bucket(self.width, start)
        return F.when(first == start, start).otherwise(plus(first, self.width)), time_bucket(self.width, end)

    def real_time(self, stored: DataFrame, rows: DataFrame, watermark: Column) -> DataFrame:
        """Stored buckets below the high-water mark, and those from there on straight from the rows."""
        return stored.filter(F.col("bucket") < watermark).unionByName(self.query(rows.filter(F.col(self.ts) >= watermark)))


def store_buckets(aggregate: DataFrame, path: str, partition: str = "day") -> None:
    """Writes buckets by day; a later write of some days replaces these alone."""
    by_day = aggregate.withColumn(partition, F.to_date("bucket"))
    by_day.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def load_buckets(spark: SparkSession, path: str, partition: str = "day") -> DataFrame:
    return spark.read.parquet(path).drop(partition)
