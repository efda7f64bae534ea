"""Streams over ``events`` that come in four deliveries, every fiftieth event two deliveries late."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import storage
from tessera.queries.registry import query
from tessera.session import table
from tessera.streaming.late import added_files, append_to_files, closed_buckets, first_deliveries, latest, upsert_versions

DELIVERIES = 4
WAIT = "1 day"

#: Deliveries, the watermark that each meets, and the rows that aren't behind it.
_DELIVERED = """
    WITH d AS (SELECT *, least(3, event_id * 4 // (SELECT count(*) FROM events) + CASE WHEN event_id % 50 = 0 THEN 2 ELSE 0 END) AS delivery FROM events),
         w AS (SELECT delivery + 1 AS delivery, date_trunc('milliseconds', max(max(ts)) OVER (ORDER BY delivery)) - INTERVAL '1 day' AS mark FROM d GROUP BY delivery),
         k AS (SELECT d.*, time_bucket(INTERVAL '1 hour', ts) AS bucket, mark, (SELECT max(mark) FROM w) AS last_mark FROM d LEFT JOIN w USING (delivery))
"""


def _deliver(spark: SparkSession, sf_dir: str, run: Callable[[str, int], object], again: bool = False) -> None:
    """Adds a delivery's files to a folder, and runs the stream over it, which starts anew from its checkpoint each time."""
    events = table(spark, sf_dir, "events")
    n = events.count()
    rows = events.withColumn("delivery", F.least(F.lit(DELIVERIES - 1), F.expr(f"event_id * {DELIVERIES} div {n} + CASE WHEN event_id % 50 = 0 THEN 2 ELSE 0 END")))
    if again:
        rows = rows.unionByName(rows.filter("event_id % 7 = 0").withColumn("delivery", F.least(F.lit(DELIVERIES - 1), F.col("delivery") + 1)))
    source = storage.new_path(spark, "source")
    for k in range(DELIVERIES):
        rows.filter(F.col("delivery") == k).drop("delivery").write.mode("append").parquet(source)
        run(source, k)


def _hours(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    stream = added_files(spark, source, table(spark, sf_dir, "events").schema)
    return closed_buckets(stream, "ts", "1 hour", ["event_type"], [F.count("*").alias("n"), F.sum("value").alias("total")], WAIT)


@query(f"""{_DELIVERED} SELECT bucket, event_type, count(*) AS n, round(sum(value), 4) AS total FROM k
           WHERE (mark IS NULL OR bucket + INTERVAL '1 hour' > mark) AND bucket + INTERVAL '1 hour' <= last_mark GROUP BY 1, 2""")
def stream_closed_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append mode into files: hours that the watermark has passed, without the rows that came behind it."""
    out, checkpoint = storage.new_path(spark, "hours"), storage.new_path(spark, "checkpoint")
    _deliver(spark, sf_dir, lambda source, k: append_to_files(_hours(spark, sf_dir, source), out, checkpoint))
    return spark.read.parquet(out).withColumn("total", F.round("total", 4))


@query(f"""{_DELIVERED} SELECT bucket, event_type, count(*) AS n, round(sum(value), 4) AS total FROM k
           WHERE mark IS NULL OR bucket + INTERVAL '1 hour' > mark GROUP BY 1, 2""")
def stream_updated_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update mode: the last version of every hour, closed or not."""
    out, checkpoint = storage.new_path(spark, "versions"), storage.new_path(spark, "checkpoint")
    _deliver(spark, sf_dir, lambda source, k: upsert_versions(_hours(spark, sf_dir, source), out, checkpoint))
    return latest(spark, out, ["bucket", "event_type"]).withColumn("total", F.round("total", 4))


@query(f"""{_DELIVERED} SELECT event_id, user_id, ts, event_type, value FROM k WHERE mark IS NULL OR ts > mark""")
def stream_first_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh event comes again in the next delivery; each comes out once, if it wasn't behind the watermark at first."""
    out, checkpoint = storage.new_path(spark, "firsts"), storage.new_path(spark, "checkpoint")

    def run(source: str, k: int) -> None:
        stream = added_files(spark, source, table(spark, sf_dir, "events").schema).select("event_id", "user_id", "ts", "event_type", "value")
        append_to_files(first_deliveries(stream, ["event_id"], "ts", WAIT), out, checkpoint)

    _deliver(spark, sf_dir, run, again=True)
    return spark.read.parquet(out)
