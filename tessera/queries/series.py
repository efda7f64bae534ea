"""Time buckets, continuous aggregates, refresh, retention, layout and streams over ``events``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.time import minus, time_bucket
from tessera.operators.timeseries import ContinuousAggregate, compressed_layout, retained
from tessera.queries.registry import query
from tessera.session import table
from tessera.streaming.refresh import bucketed, run_available, stream_table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _last(events: DataFrame) -> Column:
    """The latest time in the table as a scalar, in place of the clock."""
    return F.lit(events.agg(F.max("ts")).first()[0])


def hourly() -> ContinuousAggregate:
    moment = F.struct("ts", "event_id")
    return ContinuousAggregate(
        "ts", "1 hour", ("event_type",),
        (
            F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("n_high"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 9).alias("mean"),
            F.min("value").alias("lowest"), F.max("value").alias("highest"), F.min_by("value", moment).alias("first_value"), F.max_by("value", moment).alias("last_value"),
        ),
    )


_HOURLY_SQL = """
    SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS n_high,
           round(sum(value), 4) AS total, round(avg(value), 9) AS mean, min(value) AS lowest, max(value) AS highest,
           arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value
    FROM events GROUP BY 1, 2
"""


@query(_HOURLY_SQL)
def cagg_hourly_event_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly().query(_events(spark, sf_dir))


@query("""SELECT time_bucket(INTERVAL '1 day', ts) AS bucket, count(*) AS n, count(*) FILTER (WHERE value > 50) AS high,
                 count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE value BETWEEN 10 AND 20) AS middle FROM events GROUP BY 1""")
def cagg_filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy(time_bucket("1 day", "ts").alias("bucket")).agg(
        F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("value").between(10, 20)).alias("middle")
    )


@query("""SELECT time_bucket(INTERVAL '3 hours', ts) AS bucket, user_id, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY 1, 2""")
def cagg_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    moment = F.struct("ts", "event_id")
    return _events(spark, sf_dir).groupBy(time_bucket("3 hours", "ts").alias("bucket"), "user_id").agg(F.min_by("value", moment).alias("first_value"), F.max_by("value", moment).alias("last_value"))


@query("""SELECT time_bucket(INTERVAL '1 day', ts) AS bucket, event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 9) AS mean FROM events GROUP BY 1, 2""")
def cagg_daily_from_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolled up from stored sums and counts, as a mean of means would be wrong."""
    hourly = _events(spark, sf_dir).groupBy(time_bucket("1 hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("c"), F.sum("value").alias("s"))
    daily = hourly.groupBy(time_bucket("1 day", "hour").alias("bucket"), "event_type").agg(F.sum("c").alias("n"), F.sum("s").alias("s"))
    return daily.select("bucket", "event_type", "n", F.round("s", 4).alias("total"), F.round(F.col("s") / F.col("n"), 9).alias("mean"))


@query(f"""WITH e AS (SELECT max(ts) AS last FROM events)
           SELECT * FROM ({_HOURLY_SQL}) WHERE bucket >= time_bucket(INTERVAL '1 hour', (SELECT last FROM e) - INTERVAL '2 days') + INTERVAL '1 hour'
           AND bucket < time_bucket(INTERVAL '1 hour', (SELECT last FROM e) - INTERVAL '1 hour')""")
def cagg_refresh_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one run of a refresh policy (start 2 days, end 1 hour) computes: the whole buckets in between."""
    events = _events(spark, sf_dir)
    last = _last(events)
    return hourly().window_rows(events, minus(last, "2 days"), minus(last, "1 hour"))


@query(_HOURLY_SQL)
def cagg_incremental_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored up to a week before the end, then refreshed over the time since: as if computed at once."""
    events = _events(spark, sf_dir)
    last = _last(events)
    stored = hourly().query(events.filter(F.col("ts") < minus(last, "7 days")))
    return hourly().refresh(stored, events, minus(last, "8 days"), last + F.expr("INTERVAL '1' HOUR"))


@query(_HOURLY_SQL)
def cagg_realtime_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    mark = time_bucket("1 hour", minus(_last(events), "1 day"))
    return hourly().real_time(hourly().query(events.filter(F.col("ts") < mark)), events, mark)


@query("SELECT * FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL '7 days'")
def retention_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return retained(events, "ts", "7 days", _last(events))


@query("""SELECT * FROM events WHERE time_bucket(INTERVAL '1 day', ts) >= time_bucket(INTERVAL '1 day', (SELECT max(ts) FROM events) - INTERVAL '7 days')""")
def retention_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return retained(events, "ts", "7 days", _last(events), chunk_interval="1 day")


@query("SELECT * FROM events")
def compressed_layout_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed_layout(_events(spark, sf_dir), ["event_type"], [F.col("ts").desc_nulls_first(), F.col("event_id")])


@query("""SELECT time_bucket(INTERVAL '7 days', ts) AS chunk, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1""")
def hypertable_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy(time_bucket("7 days", "ts").alias("chunk")).agg(F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def _bucket_query(name: str, width: str, sql_width: str) -> None:
    @query(f"SELECT time_bucket(INTERVAL '{sql_width}', ts) AS bucket, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1", name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _events(spark, sf_dir).groupBy(time_bucket(width, "ts").alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


for _name, _width in (("15m", "15 minutes"), ("1h", "1 hour"), ("3h", "3 hours"), ("1d", "1 day"), ("7d", "7 days"), ("1mo", "1 month")):
    _bucket_query(f"time_bucket_{_name}", _width, _width)


@query("SELECT time_bucket(INTERVAL '3 months', o_orderdate) AS bucket, count(*) AS n FROM orders GROUP BY 1")
def time_bucket_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(time_bucket("3 months", "o_orderdate").alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aggregate as a stream over the files, in complete mode."""
    stream = stream_table(spark, f"{sf_dir}/events.parquet")
    counted = bucketed(stream, "ts", "1 hour", ["event_type"], [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")], late="2 days")
    return run_available(counted).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("""SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS previous,
                 event_id - lag(event_id) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS gap FROM events
          QUALIFY gap > 1""")
def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id")
    lagged = _events(spark, sf_dir).select("event_id", "user_id", "ts", F.lag("ts").over(order).alias("previous"), (F.col("event_id") - F.lag("event_id").over(order)).alias("gap"))
    return lagged.filter("gap > 1")


@query("""SELECT time_bucket(INTERVAL '1 day', ts) AS bucket, round(sum(value * user_id) / nullif(sum(user_id), 0), 6) AS weighted FROM events GROUP BY 1""")
def weighted_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted mean that is null, not an error, where the weights add up to zero."""
    weighted = F.round(F.sum(F.col("value") * F.col("user_id")) / F.nullif(F.sum("user_id"), F.lit(0)), 6)
    return _events(spark, sf_dir).groupBy(time_bucket("1 day", "ts").alias("bucket")).agg(weighted.alias("weighted"))
