"""Refresh by what changed, compressed chunks, ordered runs, ranges and firsts over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import storage
from tessera.operators.compression import CompressedTable, Layout, compress, decompress
from tessera.operators.invalidation import Materialization
from tessera.operators.runs import first_of_each, merged_ranges, runs, sort_within_runs
from tessera.queries.registry import query
from tessera.queries.series import _HOURLY_SQL, hourly
from tessera.session import table

#: Rows that come after the aggregate was stored: however old, they are not in any fixed window.
LATE, ON_TIME = "event_id % 50 = 0", "event_id % 50 <> 0"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _stored(spark: SparkSession, events: DataFrame) -> Materialization:
    """Stored without the late rows, which are then logged."""
    made = Materialization(spark, hourly(), storage.new_path(spark, "cagg"))
    made.create(events.filter(ON_TIME))
    made.invalidate(events.filter(LATE))
    return made


@query(_HOURLY_SQL)
def cagg_invalidation_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored aggregate after late rows were logged and a refresh has computed the buckets that they hit."""
    events = _events(spark, sf_dir)
    made = _stored(spark, events)
    made.refresh(events)
    return made.buckets()


@query("""SELECT DISTINCT time_bucket(INTERVAL '1 hour', ts) AS bucket FROM events WHERE event_id % 50 = 0""")
def cagg_invalidation_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a refresh computes again: the buckets of the late rows, and no other."""
    events = _events(spark, sf_dir)
    return _stored(spark, events).refresh(events)


@query("""WITH b AS (SELECT DISTINCT time_bucket(INTERVAL '1 hour', ts) AS b FROM events WHERE event_id % 50 = 0),
               r AS (SELECT b, sum(CASE WHEN b - p = INTERVAL '1 hour' THEN 0 ELSE 1 END) OVER (ORDER BY b) AS island FROM (SELECT b, lag(b) OVER (ORDER BY b) AS p FROM b))
          SELECT min(b) AS lo, max(b) + INTERVAL '1 hour' AS hi FROM r GROUP BY island""")
def cagg_invalidation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of changed time, in as few ranges as can be."""
    return _stored(spark, _events(spark, sf_dir)).pending()


@query("""WITH m AS (SELECT min(ts) AS a, max(ts) AS z FROM events), w AS (SELECT a + (z - a) / 4 AS lo, a + (z - a) / 2 AS hi FROM m),
               e AS (SELECT *, time_bucket(INTERVAL '1 hour', ts) AS bucket FROM events)
          SELECT bucket, event_type, count(*) AS n FROM e, w WHERE event_id % 50 <> 0 OR bucket >= lo AND bucket + INTERVAL '1 hour' <= hi GROUP BY 1, 2""")
def cagg_invalidation_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A refresh of the second quarter of the time only: changes elsewhere stay in the log and out of the buckets."""
    events = _events(spark, sf_dir)
    made = _stored(spark, events)
    lo, hi = _quarter(events, 1), _quarter(events, 2)
    made.refresh(events, lo, hi)
    return made.buckets().select("bucket", "event_type", "n")


def _quarter(events: DataFrame, k: int) -> Column:
    """The time after so many quarters of the events' whole time."""
    ends = events.agg(F.min("ts").cast("timestamp_ntz").alias("a"), F.max("ts").cast("timestamp_ntz").alias("z")).first()
    return F.lit((ends["a"] + (ends["z"] - ends["a"]) * k / 4).isoformat(sep=" ")).cast("timestamp_ntz")


def _layout() -> Layout:
    return Layout("ts", "30 days", ("event_type",), (("ts", True), ("event_id", False)))


_BATCHES_SQL = """
    SELECT time_bucket(INTERVAL '30 days', ts) AS chunk, event_type, (row_number() OVER (PARTITION BY time_bucket(INTERVAL '30 days', ts), event_type ORDER BY ts DESC, event_id) - 1) // 1000 AS batch, ts, event_id, value
    FROM events
"""


@query(f"""SELECT chunk, event_type, batch, count(*) AS n, min(ts) AS min_ts, max(ts) AS max_ts, min(event_id) AS min_event_id, max(event_id) AS max_event_id,
                  epoch_us(max(ts)) - epoch_us(min(ts)) AS last_offset, round(sum(value), 4) AS total FROM ({_BATCHES_SQL}) GROUP BY 1, 2, 3""")
def compressed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches themselves: bounds, the offsets of the times, and a sum over an array."""
    batches = compress(_events(spark, sf_dir), _layout())
    total = F.round(F.aggregate("value", F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))), 4)
    return batches.select("chunk", "event_type", "batch", "n", "min_ts", "max_ts", "min_event_id", "max_event_id", F.array_max("ts.offsets").alias("last_offset"), total.alias("total"))


@query("SELECT * FROM events")
def compressed_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return decompress(compress(events, _layout()), _layout(), events.columns)


@query("""WITH m AS (SELECT min(ts) AS a, max(ts) AS z FROM events)
          SELECT events.* FROM events, m WHERE ts >= a + (z - a) / 4 AND ts < a + (z - a) / 2""")
def compressed_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the time, from batches whose bounds don't rule it out."""
    events = _events(spark, sf_dir)
    path = storage.new_path(spark, "batches")
    compress(events, _layout()).write.parquet(path)
    return decompress(spark.read.parquet(path), _layout(), events.columns, None, _quarter(events, 1), _quarter(events, 2))


def _table_with_late_rows(spark: SparkSession, sf_dir: str) -> CompressedTable:
    """Compressed but for late rows; then chunks that ended ten days before the last event once more, with their late rows."""
    events = _events(spark, sf_dir)
    made = CompressedTable(spark, storage.new_path(spark, "compressed"), Layout("ts", "7 days", ("event_type",), (("ts", False),)))
    made.create(events)
    made.insert(events.filter(ON_TIME))
    made.compress()
    made.insert(events.filter(LATE))
    made.compress(_quarter(events, 4), "10 days")
    return made


@query("SELECT * FROM events")
def compressed_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table_with_late_rows(spark, sf_dir).read()


@query("""SELECT time_bucket(INTERVAL '7 days', ts) AS chunk, event_type,
                 count(*) FILTER (WHERE old OR event_id % 50 <> 0) AS n_batched, ceil(count(*) FILTER (WHERE old OR event_id % 50 <> 0) / 1000.0)::BIGINT AS n_batches
          FROM (SELECT *, time_bucket(INTERVAL '7 days', ts) + INTERVAL '7 days' <= (SELECT max(ts) FROM events) - INTERVAL '10 days' AS old FROM events) GROUP BY 1, 2""")
def compressed_table_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each chunk's segments have in batches: late ones only where the chunk was old enough to be compressed again."""
    batches = _table_with_late_rows(spark, sf_dir).batches()
    return batches.groupBy(F.to_timestamp_ntz("_chunk", F.lit("yyyy-MM-dd HH.mm.ss")).alias("chunk"), "event_type").agg(F.sum("n").alias("n_batched"), F.count("*").alias("n_batches"))


# ---- runs, ranges, firsts


@query("""WITH r AS (SELECT user_id, event_type, ts, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS d FROM events)
          SELECT user_id, event_type, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, round(sum(value), 4) AS total FROM r GROUP BY user_id, event_type, d""")
def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one type among a user's events."""
    marked = runs(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "event_type")
    return marked.groupBy("user_id", "run", "event_type").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).drop("run")


@query("""WITH g AS (SELECT *, event_type IS DISTINCT FROM lag(event_type) OVER w AS fresh, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
               r AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY i) AS run FROM g)
          SELECT event_id, user_id, run::INT AS run, row_number() OVER (PARTITION BY user_id, run ORDER BY i)::INT AS place, row_number() OVER (PARTITION BY user_id ORDER BY run, value DESC, i)::INT AS position FROM r""")
def events_by_value_within_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dearest event of a run first, and no event out of its run."""
    events = _events(spark, sf_dir).select("event_id", "user_id", "ts", "event_type", "value")
    placed = sort_within_runs(events, ["user_id"], ["ts", "event_id"], "event_type", [F.col("value").desc_nulls_last()])
    return runs(placed, ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "user_id", "run", "place", "position")


@query("""WITH r AS (SELECT event_type, ts AS lo, ts + INTERVAL '20 minutes' AS hi FROM events),
               s AS (SELECT *, lo > max(hi) OVER (PARTITION BY event_type ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fresh FROM r),
               i AS (SELECT *, sum(coalesce(fresh, true)::INT) OVER (PARTITION BY event_type ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM s)
          SELECT event_type, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY event_type, island""")
def busy_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each type had an event within the last twenty minutes, as few ranges as can be."""
    events = _events(spark, sf_dir).withColumn("until", F.col("ts") + F.expr("INTERVAL '20' MINUTE"))
    return merged_ranges(events, "ts", "until", "1 day", ["event_type"])


@query("""SELECT c_custkey, l_orderkey, l_linenumber, l_extendedprice, rank FROM (
              SELECT o_custkey AS c_custkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY o_custkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey)::INT AS rank
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE rank <= 3""")
def dearest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lines of each customer."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    order = [F.col("l_extendedprice").desc(), *(F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))]
    return first_of_each(lines, ["o_custkey"], order, 3).select(F.col("o_custkey").alias("c_custkey"), "l_orderkey", "l_linenumber", "l_extendedprice", "rank")
