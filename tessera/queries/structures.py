"""Graphs, stored layouts, sketches and semi-structured values over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.documents import kind, parsed, with_fields
from tessera.operators import graph
from tessera.operators.layout import store_bucketed
from tessera.operators.sketches import bound, distinct_sketches, estimates, merged_sketches
from tessera.queries.registry import query
from tessera.session import table

#: Sparse enough that not all users are in or behind one cycle.
_EDGES = """
    SELECT DISTINCT user_id AS src, next AS dst FROM (
        SELECT user_id, lead(user_id) OVER (PARTITION BY ts::DATE, event_type ORDER BY ts, event_id) AS next, event_id FROM events WHERE event_type IN ('error', 'purchase'))
    WHERE next IS NOT NULL AND (user_id < next OR event_id % 40 = 0)
      AND event_id % 5 = 0
"""


def _transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the user of an event to that of the next of its kind and day: upwards for every fifth event, downwards for fewer."""
    events = table(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "purchase"))
    following = F.lead("user_id").over(W.partitionBy(F.to_date("ts"), "event_type").orderBy("ts", "event_id"))
    pairs = events.select("user_id", "event_id", following.alias("next")).filter("next IS NOT NULL AND (user_id < next OR event_id % 40 = 0) AND event_id % 5 = 0")
    return pairs.select(F.col("user_id").alias("src"), F.col("next").alias("dst")).distinct()


@query(f"""WITH RECURSIVE e AS ({_EDGES}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
               r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src),
               held AS (SELECT DISTINCT b AS node FROM r WHERE a IN (SELECT a FROM r WHERE a = b) UNION SELECT a FROM r WHERE a = b),
               f AS (SELECT * FROM e WHERE dst NOT IN (SELECT node FROM held)),
               l(node, level) AS (SELECT node, 0 FROM n WHERE node NOT IN (SELECT dst FROM e) UNION SELECT f.dst, level + 1 FROM l JOIN f ON f.src = l.node)
          SELECT n.node, max(level)::INT AS level FROM n LEFT JOIN l ON n.node = l.node GROUP BY 1""")
def transition_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many transitions the longest way to each user has; null in and behind cycles."""
    return graph.levels(_transitions(spark, sf_dir))


@query(f"""WITH RECURSIVE e AS ({_EDGES}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
               r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src)
          SELECT n.node, least(n.node, coalesce((SELECT min(x.b) FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a = n.node), n.node)) AS component FROM n""")
def transition_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that transitions lead from one to another and back."""
    return graph.strong_components(_transitions(spark, sf_dir))


@query("""SELECT o_orderpriority, count(*) AS n_lines, round(sum(l_extendedprice), 2) AS total FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def bucketed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and lines in sixteen buckets of their key each, joined bucket by bucket."""
    orders = store_bucketed(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderkey"], 16)
    lines = store_bucketed(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice"), ["l_orderkey"], 16)
    joined = spark.table(orders).hint("merge").join(spark.table(lines), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderpriority").agg(F.count("*").alias("n_lines"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


_SEEN = """(SELECT time_bucket(INTERVAL '1 day', ts) AS bucket, event_type, count(DISTINCT user_id) AS users, count(DISTINCT event_id) AS events FROM events GROUP BY 1, 2)"""


@query(f"SELECT bucket, event_type, true AS users_fit, true AS events_fit FROM {_SEEN}")
def distinct_by_day_from_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether distinct users and events of a day, merged from hourly sketches, are within the stated error of the exact counts."""
    events = table(spark, sf_dir, "events")
    hourly = distinct_sketches(events, ["event_type"], "ts", "1 hour", {"users": F.col("user_id"), "events": F.col("event_id")})
    daily = estimates(merged_sketches(hourly, ["event_type"], "1 day", ["users", "events"]), ["users", "events"])
    exact = events.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("bucket"), "event_type").agg(F.count_distinct("user_id").alias("u"), F.count_distinct("event_id").alias("e"))
    fit = lambda got, want: F.abs(F.col(got) - F.col(want)) <= F.greatest(F.lit(1.0), bound() * F.col(want))
    return exact.join(daily, ["bucket", "event_type"], "left").select("bucket", "event_type", F.coalesce(fit("users", "u"), F.lit(False)).alias("users_fit"), F.coalesce(fit("events", "e"), F.lit(False)).alias("events_fit"))


@query("""SELECT event_id, (props->>'$.k')::INT AS k, CASE WHEN (props->>'$.k')::INT BETWEEN -128 AND 127 THEN (props->>'$.k')::TINYINT END AS small, props->>'$.k' AS shown, NULL::INT AS missing, 'object' AS whole, 'number' AS part, NULL::VARCHAR AS broken
          FROM events""")
def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed fields of a document; one isn't there, and text that is no document has no kind."""
    fields = {"k": ("$.k", "int"), "small": ("$.k", "tinyint"), "shown": ("$.k", "string"), "missing": ("$.none.deep", "int")}
    held = with_fields(table(spark, sf_dir, "events").select("event_id", "props"), "props", fields)
    document = parsed(F.col("props"))
    return held.select("event_id", *fields, kind(document).alias("whole"), kind(document, "$.k").alias("part"), kind(parsed(F.concat(F.lit("{"), "props"))).alias("broken"))
