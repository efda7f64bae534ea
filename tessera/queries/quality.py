"""Constraints and partitions of the star schema, as queries for what violates them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import integrity, partitions
from tessera.queries.registry import query
from tessera.session import table


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def pk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT * FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without a line: the reverse direction, as the true foreign keys hold."""
    return integrity.orphans(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), [("o_orderkey", "l_orderkey")])


@query("""SELECT 'orders_customer' AS fk, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
          UNION ALL SELECT 'lineitem_orders', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
          UNION ALL SELECT 'lineitem_part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)""")
def fk_orphan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: table(spark, sf_dir, n) for n in ("orders", "customer", "lineitem", "part")}
    keys = (("orders_customer", "orders", "customer", "o_custkey", "c_custkey"), ("lineitem_orders", "lineitem", "orders", "l_orderkey", "o_orderkey"), ("lineitem_part", "lineitem", "part", "l_partkey", "p_partkey"))
    counts = [integrity.orphans(t[c], t[p], [(a, b)]).agg(F.lit(name).alias("fk"), F.count("*").alias("n")) for name, c, p, a, b in keys]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("SELECT l_orderkey, l_linenumber, l_discount, l_quantity FROM lineitem WHERE NOT (l_discount <= 0.08 AND l_quantity BETWEEN 1 AND 45)")
def check_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = integrity.check_violations(table(spark, sf_dir, "lineitem"), (F.col("l_discount") <= 0.08) & F.col("l_quantity").between(1, 45))
    return bad.select("l_orderkey", "l_linenumber", "l_discount", "l_quantity")


@query("SELECT 'o_orderkey' AS column_name, count(*) FILTER (WHERE o_orderkey IS NULL) AS n FROM orders UNION ALL SELECT 'late', count(*) FILTER (WHERE CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 1 END IS NULL) FROM orders")
def not_null_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.null_keys(table(spark, sf_dir, "orders").withColumn("late", F.when(F.col("o_orderstatus") != "P", 1)), ["o_orderkey", "late"])


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('O', 'F')")
def enum_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.enum_violations(table(spark, sf_dir, "orders"), "o_orderstatus", ["O", "F"]).select("o_orderkey", "o_orderstatus")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT regexp_matches(c_name, '0[0-4]$')")
def domain_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.domain_violations(table(spark, sf_dir, "customer"), "c_name", "0[0-4]$").select("c_custkey", "c_name")


@query("""WITH r AS (SELECT event_id, user_id, event_type, ts AS lo, ts + INTERVAL '30 minutes' AS hi FROM events)
          SELECT event_id FROM r a WHERE EXISTS (SELECT 1 FROM r b WHERE a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id <> b.event_id AND a.lo < b.hi AND b.lo < a.hi)""")
def exclude_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exclusion constraint over half an hour after each event of a user and type."""
    ranges = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").alias("lo"), (F.col("ts") + F.expr("INTERVAL '30' MINUTE")).alias("hi"))
    return integrity.overlapping(ranges, ["user_id", "event_type"], "lo", "hi", "event_id").select("event_id")


@query("SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2 HAVING count(*) > 1")
def partial_unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.duplicate_keys(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], where=F.col("o_orderstatus") == "O")


_NULLABLE = "SELECT c_nationkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer"


@query(f"SELECT 'distinct' AS mode, c_nationkey, segment, count(*) AS n FROM ({_NULLABLE}) WHERE segment IS NOT NULL GROUP BY 2, 3 HAVING count(*) > 1 UNION ALL SELECT 'not distinct', c_nationkey, segment, count(*) FROM ({_NULLABLE}) GROUP BY 2, 3 HAVING count(*) > 1")
def nulls_not_distinct_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_nationkey", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("segment"))
    modes = [integrity.duplicate_keys(rows, ["c_nationkey", "segment"], d).select(F.lit(m).alias("mode"), "*") for m, d in (("distinct", True), ("not distinct", False))]
    return modes[0].unionByName(modes[1])


@query("SELECT o_orderkey, (o_orderkey % 16)::INTEGER AS remainder FROM orders")
def hash_partition_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", partitions.hash_partition(F.col("o_orderkey"), 16).alias("remainder"))


@query("""WITH d(parent, modulus, remainder) AS (VALUES ('orders', 4, 0), ('orders', 4, 2), ('items', 3, 0), ('items', 3, 1), ('items', 3, 2))
          SELECT p.parent, p.modulus, r.remainder::INTEGER AS remainder FROM (SELECT DISTINCT parent, modulus FROM d) p, LATERAL (SELECT unnest(range(p.modulus)) AS remainder) r
          WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.parent = p.parent AND d.modulus = p.modulus AND d.remainder = r.remainder)""")
def hash_partition_missing_remainders(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = spark.createDataFrame([("orders", 4, 0), ("orders", 4, 2), ("items", 3, 0), ("items", 3, 1), ("items", 3, 2)], "parent string, modulus int, remainder int")
    return partitions.missing_remainders(spark, declared)


@query("""SELECT i::INTEGER AS remainder, 'orders_' || lpad(i::VARCHAR, 2, '0') AS name, 'CREATE TABLE public.orders_' || lpad(i::VARCHAR, 2, '0') || ' PARTITION OF public.orders FOR VALUES WITH (MODULUS 16, REMAINDER ' || i || ');' AS sql FROM range(16) t(i)""")
def hash_partition_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitions.partition_ddl(spark, "orders", 16)


@query("""SELECT CASE WHEN l_shipdate < TIMESTAMP '1997-01-01' THEN 'p_old' WHEN l_shipdate < TIMESTAMP '1999-01-01' THEN 'p_mid' ELSE 'p_new' END AS part, count(*) AS n FROM lineitem GROUP BY 1""")
def range_partition_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datetime import datetime

    bounds = {"p_old": (None, datetime(1997, 1, 1)), "p_mid": (datetime(1997, 1, 1), datetime(1999, 1, 1)), "p_new": (datetime(1999, 1, 1), None)}
    return table(spark, sf_dir, "lineitem").groupBy(partitions.range_partition(F.col("l_shipdate"), bounds).alias("part")).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'p_heavy' WHEN c_mktsegment IN ('AUTOMOBILE') THEN 'p_auto' ELSE 'p_default' END AS part, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1""")
def list_partition_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = {"p_heavy": ["BUILDING", "MACHINERY"], "p_auto": ["AUTOMOBILE"]}
    return table(spark, sf_dir, "customer").groupBy(partitions.list_partition(F.col("c_mktsegment"), lists, "p_default").alias("part")).agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT p_partkey, CASE WHEN p_retailprice >= 900 AND p_retailprice < 930 THEN 'p_low' WHEN p_retailprice >= 930 AND p_retailprice < 960 THEN 'p_mid' ELSE 'p_default' END AS part FROM part")
def default_partition_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", partitions.range_partition(F.col("p_retailprice"), {"p_low": (900, 930), "p_mid": (930, 960)}, "p_default").alias("part"))
