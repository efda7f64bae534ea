"""Directed graphs as tables of edges: levels by peeling, what cycles hold back, strongly connected components.

Every round is a few joins with a frontier, the nodes that the round before has settled, and ends in a reliable checkpoint.
The driver learns how many nodes are left and nothing of them. Edges that are repeated or lead from a node to itself
are allowed; nulls are no nodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import storage


def _cut(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(storage.shared_dir(spark))
    return df.checkpoint()


def _edges(edges: DataFrame, src: str, dst: str) -> DataFrame:
    return edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL").distinct()


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def levels(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, level): how many edges the longest way to each node has, from those that none leads to; null for the nodes of cycles and
    all that lie behind one.

    A round takes the nodes that no edge of a node left leads to off the graph, with their edges. There are as many rounds as levels.
    """
    left = _cut(_edges(edges, src, dst))
    nodes = _cut(_nodes(left))
    done: list[DataFrame] = []
    while True:
        free = _cut(nodes.join(left.select(F.col("b").alias("node")).distinct(), "node", "left_anti").withColumn("level", F.lit(len(done))))
        if free.isEmpty():
            break
        done.append(free)
        left = _cut(left.join(free.select(F.col("node").alias("a")), "a", "left_anti"))
        nodes = _cut(nodes.join(free, "node", "left_anti"))
    rest = nodes.select("node", F.lit(None).cast("int").alias("level"))
    return reduce(DataFrame.unionByName, [*done, rest])


def reached(edges: DataFrame, start: DataFrame, backwards: bool = False) -> DataFrame:
    """(label, node): the nodes that lie behind, or before, each of ``start`` (label, node), with these, by edges (a, b, label) that stay within a
    label. Each round joins the nodes that the last one has found with their edges."""
    here, there = ("b", "a") if backwards else ("a", "b")
    steps = edges.select("label", F.col(here).alias("node"), F.col(there).alias("next"))
    seen = frontier = _cut(start.select("label", "node").distinct())
    while True:
        found = frontier.join(steps, ["label", "node"]).select("label", F.col("next").alias("node")).distinct()
        frontier = _cut(found.join(seen, ["label", "node"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = _cut(seen.unionByName(frontier))


def strong_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): nodes that lead to one another share the least of them; a node of no cycle is its own component.

    Nodes that nothing leads to, or that lead nowhere, are set apart first, again and again. What is left is divided: of each
    part the least node's descendants and its ancestors are found, all parts at once; those that are both are its component, and
    what is only the one, only the other, and neither, are three parts of their own that share no cycle.
    """
    every = _cut(_edges(edges, src, dst))
    done = [_nodes(every)]
    left = _cut(every.filter("a <> b").withColumn("label", F.lit(0).cast("long")))
    found: list[DataFrame] = []
    while True:
        while True:  # off with the ends, which are in no cycle of their part
            both = left.select("label", F.col("a").alias("node")).intersect(left.select("label", F.col("b").alias("node")))
            kept = _cut(left.join(both.withColumnRenamed("node", "a"), ["label", "a"], "left_semi").join(both.withColumnRenamed("node", "b"), ["label", "b"], "left_semi").select("a", "b", "label"))
            before, now = left.count(), kept.count()
            left = kept
            if before == now:
                break
        if not now:
            break
        start = _cut(left.groupBy("label").agg(F.min("a").alias("node")))
        down, up = reached(left, start), reached(left, start, backwards=True)
        nodes = left.select("label", F.explode(F.array("a", "b")).alias("node")).distinct()
        side = lambda df, name: df.withColumn(name, F.lit(1))
        marked = nodes.join(side(down, "down"), ["label", "node"], "left").join(side(up, "up"), ["label", "node"], "left").fillna(0, ["down", "up"])
        marked = _cut(marked.join(start.withColumnRenamed("node", "least"), "label"))
        found.append(marked.filter("down = 1 AND up = 1").select("node", F.col("least").alias("component")))
        parts = marked.filter("down = 0 OR up = 0").select("node", "label", F.xxhash64("label", "down", "up").alias("part"))
        ends = lambda c: parts.select("label", F.col("node").alias(c), F.col("part").alias(f"part_{c}"))
        left = left.join(ends("a"), ["label", "a"]).join(ends("b"), ["label", "b"]).filter("part_a = part_b")
        # no edge joins two parts, so two that got the same name by chance only wait for each other
        left = _cut(left.select("a", "b", F.col("part_a").alias("label")))
    if not found:
        return done[0].withColumn("component", F.col("node"))
    cycles = reduce(DataFrame.unionByName, found)
    return done[0].join(cycles, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
