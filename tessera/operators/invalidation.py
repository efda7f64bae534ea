"""Continuous aggregates that are refreshed by what has changed.

A materialisation is a folder with the buckets of an aggregate, by day, and a log of changed time ranges. Whoever inserts,
changes or deletes rows adds the buckets that they lie in to the log, however old these are. A refresh merges the log's
ranges, takes what lies in its window, computes those buckets again from the rows, and replaces them; what is outside the window
stays in the log.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import storage
from tessera.functions.time import as_interval, interval_parts, time_bucket
from tessera.operators.runs import merged_ranges
from tessera.operators.timeseries import ContinuousAggregate, store_buckets

#: Ranges that are said to the scan one by one; more are said by their first begin and last end.
SCAN_RANGES = 64


@dataclass(frozen=True)
class Materialization:
    """A stored aggregate at ``path``. ``slab`` is the length of time that ranges are merged in at once."""

    spark: SparkSession
    aggregate: ContinuousAggregate
    path: str
    slab: str = "7 days"

    @property
    def _buckets(self) -> str:
        return f"{self.path}/buckets"

    @property
    def _log(self) -> str:
        return f"{self.path}/log"

    def create(self, rows: DataFrame, with_data: bool = True) -> None:
        """Stores the buckets of ``rows``; without data none, and the log says that all buckets with rows are to be computed."""
        computed, log = self.aggregate.query(rows), self.changed(rows)
        computed.limit(0).write.mode("overwrite").parquet(f"{self.path}/schema")
        store_buckets(computed if with_data else computed.limit(0), self._buckets)
        (log.limit(0) if with_data else log).write.mode("overwrite").parquet(self._log)

    def changed(self, rows: DataFrame) -> DataFrame:
        """(lo, hi) of the buckets that ``rows`` lie in; rows without a time lie in none."""
        lo = time_bucket(self.aggregate.width, self.aggregate.ts)
        return rows.select(lo.alias("lo")).filter("lo IS NOT NULL").distinct().withColumn("hi", F.col("lo") + as_interval(self.aggregate.width))

    def invalidate(self, rows: DataFrame) -> None:
        """Logs rows that were inserted or deleted; of changed rows, both as they were and as they are."""
        merged_ranges(self.changed(rows), "lo", "hi", self.slab).write.mode("append").parquet(self._log)

    def pending(self) -> DataFrame:
        """(lo, hi): what has changed since it was computed last, in as few ranges as can be."""
        return merged_ranges(self.spark.read.schema("lo timestamp_ntz, hi timestamp_ntz").parquet(self._log), "lo", "hi", self.slab)

    def buckets(self) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.path}/schema").schema
        return self.spark.read.schema(schema.add("day", "date")).parquet(self._buckets).drop("day")

    def refresh(self, rows: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
        """Computes the changed buckets that lie whole in ``[start, end)`` again, from ``rows`` as they are now, and returns these
        (bucket alone, those that had or have a row). None is no bound. Running it again changes nothing.

        Only days that hold such buckets are written. The log is cut last: a refresh that is broken off is done again.
        """
        bucket = self.aggregate.width
        pending = self.pending()
        low = F.lit(None).cast("timestamp_ntz") if start is None else start.cast("timestamp_ntz")
        high = F.lit(None).cast("timestamp_ntz") if end is None else end.cast("timestamp_ntz")
        first = F.when(time_bucket(bucket, low) == low, low).otherwise(time_bucket(bucket, low) + as_interval(bucket))
        last = time_bucket(bucket, high)
        now = pending.select(F.greatest("lo", first).alias("lo"), F.least("hi", last).alias("hi")).filter("lo < hi")  # null bounds are passed over
        kept = pending.select("lo", F.least("hi", first).alias("hi")).filter(first.isNotNull() & (F.col("lo") < F.col("hi")))
        kept = kept.unionByName(pending.select(F.greatest("lo", last).alias("lo"), "hi").filter(last.isNotNull() & (F.col("lo") < F.col("hi"))))
        work = storage.new_path(self.spark, "refresh")
        now.write.parquet(f"{work}/now")
        kept.write.parquet(f"{work}/kept")
        now = self.spark.read.parquet(f"{work}/now")

        ts = self.aggregate.ts
        fresh = self.aggregate.query(self._within(rows.filter(self._bounds(now, ts)), F.col(ts).cast("timestamp_ntz"), now))
        stored = self.buckets()
        hit = self._within(stored.filter(self._bounds(now, "bucket")), F.col("bucket"), now)
        fresh.withColumn("_day", F.to_date("bucket")).write.parquet(f"{work}/fresh")
        hit.select("bucket", F.to_date("bucket").alias("_day")).distinct().write.parquet(f"{work}/hit")
        fresh, hit = self.spark.read.parquet(f"{work}/fresh"), self.spark.read.parquet(f"{work}/hit")

        days = fresh.select("_day").union(hit.select("_day")).distinct()
        same = stored.withColumn("_day", F.to_date("bucket")).join(days, "_day", "left_semi").join(hit.select("bucket"), "bucket", "left_anti")
        new = same.select(*stored.columns).unionByName(fresh.select(*stored.columns))
        new.write.parquet(f"{work}/new")
        new = self.spark.read.parquet(f"{work}/new")
        store_buckets(new, self._buckets)
        # days that have no bucket left aren't written, so their folders go
        for r in days.join(new.select(F.to_date("bucket").alias("_day")).distinct(), "_day", "left_anti").collect():
            storage.remove(self.spark, f"{self._buckets}/day={r['_day']}")
        self.spark.read.parquet(f"{work}/kept").write.mode("overwrite").parquet(self._log)
        return fresh.select("bucket").union(hit.select("bucket")).distinct()

    def real_time(self, rows: DataFrame) -> DataFrame:
        """The aggregate as of now without a refresh: stored buckets that haven't changed, and those that have from ``rows``."""
        ranges = self.pending()
        fresh = self.aggregate.query(self._within(rows, F.col(self.aggregate.ts).cast("timestamp_ntz"), ranges))
        stored = self.buckets()
        hit = self._within(stored.select("bucket").distinct(), F.col("bucket"), ranges)
        return stored.join(hit, "bucket", "left_anti").select(*stored.columns).unionByName(fresh.select(*stored.columns))

    def _bounds(self, ranges: DataFrame, ts: str) -> Column:
        """What the scan is told of disjoint ranges; it may let more rows through."""
        some = ranges.orderBy("lo").limit(SCAN_RANGES + 1).collect()
        if not some:
            return F.lit(False)
        if len(some) > SCAN_RANGES:
            some = ranges.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
        at = lambda t: F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")
        return reduce(lambda a, b: a | b, ((F.col(ts) >= at(r["lo"])) & (F.col(ts) < at(r["hi"])) for r in some))

    def _within(self, rows: DataFrame, ts: Column, ranges: DataFrame) -> DataFrame:
        """Rows inside one of disjoint ranges that consist of whole buckets: a range's parts in each slab meet that slab's rows."""
        step = "1 day" if not interval_parts(self.aggregate.width)[0] and interval_parts(self.aggregate.width)[1] <= 86_400 else self.slab
        last = time_bucket(step, F.col("hi") - F.expr("INTERVAL '0.000001' SECOND"))
        parts = ranges.select(F.explode(F.sequence(time_bucket(step, "lo"), last, as_interval(step))).alias("_part"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
        return rows.withColumns({"_at": ts, "_p": time_bucket(step, ts)}).join(parts, (F.col("_p") == F.col("_part")) & (F.col("_at") >= F.col("_lo")) & (F.col("_at") < F.col("_hi")), "left_semi").drop("_at", "_p")
