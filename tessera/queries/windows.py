"""Range joins, sessions, sliding windows and declared functions over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.routines import install
from tessera.operators.windows import overlap_join, range_sums, sessions, sliding
from tessera.queries.registry import query
from tessera.session import table

_ORDER_WINDOWS = """
    SELECT o_orderkey, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(o_orderkey * 17 % 43200) AS lo,
           TIMESTAMP '2024-01-01 00:00:00' + to_minutes(o_orderkey * 17 % 43200 + 10 + o_custkey % 50) AS hi FROM orders
"""


def _minutes_in(minutes: str):
    return F.expr(f"TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast({minutes} as int))")


def _order_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's own window of ten minutes to an hour, in the month of the events."""
    return table(spark, sf_dir, "orders").select("o_orderkey", _minutes_in("o_orderkey * 17 % 43200").alias("lo"), _minutes_in("o_orderkey * 17 % 43200 + 10 + o_custkey % 50").alias("hi"))


@query(f"""SELECT o_orderkey, count(event_id) AS n, round(coalesce(sum(value), 0), 4) AS total, max(ts) AS last_ts
           FROM ({_ORDER_WINDOWS}) LEFT JOIN events ON ts >= lo AND ts < hi GROUP BY 1""")
def events_in_order_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order what happens in its own window."""
    windows = _order_windows(spark, sf_dir)
    sums = {"n": F.lit(1).cast("long"), "total": F.col("value")}
    found = range_sums(windows, table(spark, sf_dir, "events"), "lo", "hi", "ts", "1 minute", sums, "last_ts")
    out = windows.join(found, ["lo", "hi"], "left").groupBy("o_orderkey").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("last_ts").alias("last_ts"))
    return out.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("total", F.lit(0.0)), 4).alias("total"), "last_ts")


@query("""WITH a AS (SELECT user_id, event_id AS a_id, ts AS a_lo, ts + to_minutes((event_id % 90)::INT) AS a_hi FROM events WHERE event_type = 'purchase'),
               b AS (SELECT user_id, event_id AS b_id, ts AS b_lo, ts + to_minutes((event_id % 400)::INT) AS b_hi FROM events WHERE event_type = 'error')
          SELECT user_id, a_id, b_id FROM a JOIN b USING (user_id) WHERE a_lo < b_hi AND b_lo < a_hi AND a_lo < a_hi AND b_lo < b_hi""")
def overlapping_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times after a user's purchases that overlap with times after their errors."""
    events = table(spark, sf_dir, "events")
    after = lambda kind, name, most: events.filter(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(f"{name}_id"), F.col("ts").alias(f"{name}_lo"), F.expr(f"ts + make_dt_interval(0, 0, cast(event_id % {most} as int))").alias(f"{name}_hi"))
    return overlap_join(after("purchase", "a", 90), after("error", "b", 400), ("a_lo", "b_lo"), ("a_hi", "b_hi"), "30 minutes", ["user_id"]).select("user_id", "a_id", "b_id")


@query("""WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL '2 hours', true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
               s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
          SELECT user_id, min(ts) AS session_start, max(ts) AS last_ts, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, round(sum(value), 4) AS total FROM s GROUP BY user_id, session""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end once more than two hours pass without an event."""
    sums = {"n": F.lit(1).cast("long"), "purchases": F.when(F.col("event_type") == "purchase", 1).otherwise(0).cast("long"), "total": F.col("value")}
    return sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", "2 hours", sums).withColumn("total", F.round("total", 4))


@query("""SELECT event_type, s AS window_start, count(*) AS n, round(sum(value), 4) AS total
          FROM (SELECT event_type, value, unnest(generate_series(time_bucket(INTERVAL '1 hour', ts) - INTERVAL '23 hours', time_bucket(INTERVAL '1 hour', ts), INTERVAL '1 hour')) AS s FROM events) GROUP BY 1, 2""")
def sliding_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's sums, every hour."""
    made = sliding(table(spark, sf_dir, "events"), ["event_type"], "ts", "24 hours", "1 hour", {"n": F.lit(1).cast("long"), "total": F.col("value")})
    return made.withColumn("total", F.round("total", 4))


#: Declared as a schema's own files declare them.
FUNCTIONS = """
CREATE OR REPLACE FUNCTION net_price(price double precision, discount double precision DEFAULT 0) RETURNS double precision
    LANGUAGE sql IMMUTABLE STRICT AS $$ SELECT price * (1 - discount) $$;
CREATE FUNCTION price_band(double precision) RETURNS text LANGUAGE sql AS $$
    SELECT CASE WHEN $1 < 100000 THEN 'low' WHEN $1 < 300000 THEN 'middle' ELSE 'high' END $$;
CREATE FUNCTION lines_of(order_key bigint) RETURNS TABLE (line_number integer, net double precision) LANGUAGE sql STABLE AS $$
    SELECT l_linenumber, net_price(l_extendedprice, l_discount) FROM lineitem WHERE l_orderkey = order_key $$;
"""


@query("""SELECT price_band, count(*) AS n_lines, count(DISTINCT o_orderkey) AS n_orders, round(sum(net), 2) AS net
          FROM (SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 300000 THEN 'middle' ELSE 'high' END AS price_band, l_extendedprice * (1 - l_discount) AS net
                FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY 1""")
def declared_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scalar functions and one of a table, called through LATERAL, whose bodies are part of the plan."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    install(spark, FUNCTIONS)
    return spark.sql("""
        SELECT price_band(o_totalprice) AS price_band, count(*) AS n_lines, count(DISTINCT o_orderkey) AS n_orders, round(sum(net), 2) AS net
        FROM orders, LATERAL lines_of(o_orderkey) GROUP BY 1""")
