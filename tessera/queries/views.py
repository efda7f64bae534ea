"""Declared views over the star schema: projection, predicates, joins, grouping, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.time import minus
from tessera.queries.registry import query
from tessera.session import table


@query("""SELECT c.c_custkey AS id, max(o.o_orderdate) AS last_order, count(o.o_orderkey) AS n_recent,
                 CASE WHEN count(o.o_orderkey) > 3 THEN 'active' WHEN count(o.o_orderkey) > 0 THEN 'casual' ELSE 'idle' END AS status
          FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL '1 year' GROUP BY 1""")
def activity_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join on a key and a range of time; ``now()`` is the latest order."""
    orders = table(spark, sf_dir, "orders")
    recent = orders.filter(F.col("o_orderdate") >= minus(F.lit(orders.agg(F.max("o_orderdate")).first()[0]), "1 year"))
    joined = table(spark, sf_dir, "customer").join(recent, F.col("o_custkey") == F.col("c_custkey"), "left")
    n = F.count("o_orderkey")
    return joined.groupBy(F.col("c_custkey").alias("id")).agg(
        F.max("o_orderdate").alias("last_order"), n.alias("n_recent"), F.when(n > 3, "active").when(n > 0, "casual").otherwise("idle").alias("status")
    )


_LINKS = """SELECT l.l_orderkey AS item, l.l_linenumber AS link, n.n_name AS collection
    FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
    JOIN part p ON p.p_partkey = l.l_partkey
    WHERE l.l_returnflag IN ('A', 'R') AND o.o_orderstatus IS DISTINCT FROM 'P'
      AND (p.p_size < 10 OR EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = l.l_suppkey AND s.s_nationkey = c.c_nationkey))"""


@query(_LINKS)
def published_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four inner joins, a null-safe comparison, and an EXISTS under OR, which becomes an existence join."""
    tables = {t[0]: table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "part", "supplier")}
    return spark.sql(
        _LINKS.replace("lineitem l", "{l} l").replace("orders o", "{o} o").replace("customer c", "{c} c").replace("nation n", "{n} n").replace("part p", "{p} p").replace("supplier s", "{s} s"), **tables
    )


@query("""SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def monthly_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT date_trunc('MONTH', o_orderdate) AS month, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY 1", orders=table(spark, sf_dir, "orders"))


@query("SELECT c_custkey AS id, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier UNION ALL SELECT c_custkey, 'customer' FROM customer WHERE c_acctbal < 0")
def union_all_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    ids = customer.select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"))
    return ids.unionByName(supplier.select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind"))).unionByName(ids.where(F.col("c_acctbal") < 0))


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def view_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def view_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def view_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")).subtract(orders.where("o_orderstatus = 'P'").select("o_custkey"))


@query("""SELECT o_orderkey, upper(trim(o_orderpriority)) AS priority, o_totalprice::DECIMAL(18, 2) AS price FROM orders
          WHERE o_orderstatus IN ('O', 'F') AND o_totalprice BETWEEN 1000 AND 150000 AND o_orderpriority ILIKE '%high%' AND NOT o_orderkey % 3 = 0 AND o_custkey <> 7""")
def view_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IN, BETWEEN, ILIKE, NOT, arithmetic, casts; all but the last reach the scan as pushed filters."""
    kept = table(spark, sf_dir, "orders").where(
        F.col("o_orderstatus").isin("O", "F") & F.col("o_totalprice").between(1000, 150000) & F.col("o_orderpriority").ilike("%high%") & ~(F.col("o_orderkey") % 3 == 0) & (F.col("o_custkey") != 7)
    )
    return kept.select("o_orderkey", F.upper(F.trim("o_orderpriority")).alias("priority"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))


@query("""SELECT p_brand AS brand, count(*) AS n, round(avg(p_retailprice), 4) AS price FROM part WHERE p_size > 5 GROUP BY brand HAVING count(*) > 10 AND avg(p_retailprice) > 0""")
def view_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size > 5").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"), F.avg("p_retailprice").alias("a")).where("n > 10 AND a > 0").select("brand", "n", F.round("a", 4).alias("price"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey ASC NULLS LAST LIMIT 25 OFFSET 5")
def view_order_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is a limit: the top of an order, with the nulls where the declared dialect has them."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc_nulls_first(), F.col("o_orderkey").asc_nulls_last()).offset(5).limit(25)


@query("SELECT DISTINCT c_mktsegment AS segment, c_nationkey AS nation FROM customer")
def view_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")).distinct()


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
def view_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select("o_custkey")
    return table(spark, sf_dir, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT n.n_name AS nation, r.r_name AS region, (SELECT count(*) FROM supplier s WHERE s.s_nationkey = n.n_nationkey) AS n_suppliers FROM nation n CROSS JOIN region r WHERE n.n_regionkey = r.r_regionkey")
def view_scalar_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correlated scalar subquery and a cross join with a predicate: Catalyst makes equi joins of both."""
    nation, region, supplier = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    return spark.sql(
        "SELECT n.n_name AS nation, r.r_name AS region, (SELECT count(*) FROM {s} s WHERE s.s_nationkey = n.n_nationkey) AS n_suppliers FROM {n} n CROSS JOIN {r} r WHERE n.n_regionkey = r.r_regionkey",
        n=nation, r=region, s=supplier,
    )


@query("""WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1) SELECT c_mktsegment AS segment, count(*) AS n, round(max(total), 2) AS most FROM spend JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def view_cte(spark: SparkSession, sf_dir: str) -> DataFrame:
    spend = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    return spend.join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.round(F.max("total"), 2).alias("most"))


@query("""SELECT r_name AS region, n_name AS nation, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def view_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return joined.rollup(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.expr("TIMESTAMP_NTZ'1998-09-02 00:00:00'")).groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n")
    )
