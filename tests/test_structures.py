"""Graphs, stored layouts, sketches and documents: brute force, odd rows, plans."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.functions.documents import kind, parsed, with_fields
from tessera.operators import graph
from tessera.operators.layout import store_bucketed
from tessera.operators.sketches import bound, distinct_sketches, estimates, merged_sketches


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def slow_levels(edges):
    nodes = {x for e in edges for x in e}
    out, left = {}, set(edges)
    for level in range(len(nodes)):
        free = {n for n in nodes if n not in out and not any(b == n for _, b in left)}
        out |= dict.fromkeys(free, level)
        left = {e for e in left if e[0] not in free}
    return {n: out.get(n) for n in nodes}


def slow_components(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            reach[a] |= reach[b]
    return {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}


GRAPHS = {
    "none": [], "loop": [(1, 1)], "chain": [(i, i + 1) for i in range(6)], "ring": [(i, (i + 1) % 5) for i in range(5)],
    "rings": [(0, 1), (1, 0), (1, 2), (2, 3), (3, 2), (3, 4), (9, 0), (9, 9)], "eight": [(5, 1), (1, 5), (1, 7), (7, 1), (7, 8)],
}


@pytest.mark.parametrize("name", [*GRAPHS, "random"])
def test_levels_and_components_are_those_of_brute_force(spark, name):
    r = random.Random(11)
    edges = GRAPHS.get(name) if name != "random" else [(r.randrange(40), r.randrange(40)) for _ in range(55)]
    df = spark.createDataFrame([*edges, *edges[:2], (None, 1), (1, None)] if edges else [], "src long, dst long")
    assert {x.node: x.level for x in graph.levels(df).collect()} == slow_levels(edges)
    assert {x.node: x.component for x in graph.strong_components(df).collect()} == slow_components(edges)


def test_joins_of_buckets_have_no_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = store_bucketed(spark.range(1_000).selectExpr("id AS k", "id % 7 AS v"), ["k"], 8)
        right = store_bucketed(spark.range(0, 2_000, 3).selectExpr("id AS j", "'x' AS w"), ["j"], 8)
        joined = spark.table(left).join(spark.table(right), F.col("k") == F.col("j"))
        assert joined.count() == 334
        text = plan(joined)
        assert "SortMergeJoin" in text and "Exchange" not in text
        counted = plan(spark.table(left).groupBy("k").count())
        assert "Exchange" not in counted
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_partitions_are_pruned_by_the_other_side(spark):
    facts = store_bucketed(spark.range(1_000).selectExpr("id AS k", "id % 10 AS part"), ["k"], 2, partition_by=["part"])
    few = spark.createDataFrame([(3, "a"), (4, "b")], "part long, name string").filter("name = 'a'")
    joined = spark.table(facts).join(F.broadcast(few), "part")
    assert joined.count() == 100 and "dynamicpruning" in plan(joined).lower()


def test_the_registered_join_meets_bucket_by_bucket(spark, sf_dir):
    from tessera.queries import QUERIES

    text = plan(QUERIES["bucketed_join"](spark, sf_dir))
    below = text[text.index("SortMergeJoin") :]
    assert "Exchange" not in below and below.count("Bucketed: true") == 2


def test_sketches_add_up(spark):
    t = datetime(2024, 1, 1)
    rows = [(t + timedelta(minutes=i), i % 3_000, "a") for i in range(8_000)] + [(None, 1, "a"), (t, None, "b")]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, u int, k string")
    hourly = distinct_sketches(df, ["k"], "ts", "1 hour", {"u": F.col("u")})
    got = {(r.bucket, r.k): r.u for r in estimates(merged_sketches(hourly, ["k"], "7 days", ["u"]), ["u"]).collect()}
    assert got[t, "b"] == 0 and abs(got[t, "a"] - 3_000) <= bound() * 3_000
    assert estimates(merged_sketches(hourly.limit(0), ["k"], "1 day", ["u"]), ["u"]).count() == 0
    assert 0.06 < bound() < 0.07


def test_documents_are_parsed_once_and_fail_gently(spark):
    rows = ['{"a": 300, "b": {"c": [1, "x", null]}, "t": true, "s": "7"}', "{", None, "[]", '"x"', "5", "null"]
    df = spark.createDataFrame([(i, x, 0) for i, x in enumerate(rows)], "id int, doc string, a int")
    out = with_fields(df.drop("a"), "doc", {"a": ("$.a", "int"), "tiny": ("$.a", "tinyint"), "deep": ("$.b.c[1]", "string"), "s": ("$.s", "int"), "bad": ("$.b", "int")})
    got = {r.id: tuple(r)[2:] for r in out.collect()}
    assert got[0] == (300, None, "x", 7, None) and all(v == (None,) * 5 for i, v in got.items() if i)
    kinds = df.select("id", kind(parsed(F.col("doc"))).alias("k"), kind(parsed(F.col("doc")), "$.b.c[2]").alias("n"), kind(parsed(F.col("doc")), "$.t").alias("t")).orderBy("id").collect()
    assert [r.k for r in kinds] == ["object", None, None, "array", "string", "number", "null"]
    assert kinds[0].n == "null" and kinds[0].t == "boolean" and kinds[3].t is None
    assert plan(out).count("try_parse_json") + plan(out).count("parse_json(doc") <= 2
