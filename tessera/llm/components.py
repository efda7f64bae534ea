"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step over ``a > b`` edges: joins neighbours to the least node of each neighbourhood."""
    if small:
        sided = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    else:
        sided = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")
    least = sided.groupBy("u").agg(F.min("v").alias("m0")).select("u", F.least("u", "m0").alias("m"))
    joined = sided.join(least, "u")
    if small:
        # u itself and all its smaller neighbours go to the least of them
        out = joined.select(F.explode(F.array("u", "v")).alias("x"), "m")
    else:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("x"), "m")
    return out.filter(F.col("x") != F.col("m")).select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the least node it is connected with.

    Nodes may be of any ordered type. Loops, repeated and reversed edges are allowed; null ends are ignored. Every
    round is a checkpoint, and the number of rounds grows with the logarithm of the longest path.
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct()
    e = cut(e)
    before = None
    while True:
        e = cut(_star(_star(e, small=False), small=True))
        # stable once no node points to a node that itself points on, and nothing changed
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
