"""Operators on small inputs: nulls, ties, empty tables."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions.time import interval_parts, minus, time_bucket
from tessera.operators import integrity, partitions
from tessera.operators.timeseries import ContinuousAggregate, load_buckets, retained, store_buckets, with_space, write_chunks
from tessera.streaming.refresh import bucketed, refresh_by_batch, run_available, stream_table


@pytest.mark.parametrize(("text", "parts"), [("1 hour", (0, 3600)), ("01:30:00", (0, 5400)), ("2 weeks 1 day", (0, 15 * 86400)), ("1 year 2 months", (14, 0)), ("90 min", (0, 5400))])
def test_intervals(text, parts):
    assert interval_parts(text) == parts


def test_buckets_count_from_a_monday_and_take_nulls(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 3, 5, 7),), (datetime(1999, 12, 31, 23),), (None,)], "ts timestamp_ntz")
    week = [r[0] for r in df.select(time_bucket("7 days", "ts")).collect()]
    assert week == [datetime(2024, 1, 1), datetime(1999, 12, 27), None]
    assert df.select(time_bucket("3 months", "ts")).first()[0] == datetime(2024, 1, 1) and df.select(minus(F.col("ts"), "1 month")).first()[0] == datetime(2023, 12, 3, 5, 7)
    with pytest.raises(ValueError):
        time_bucket("1 month 1 day", "ts")


def test_duplicate_keys_and_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a"), (2, "a"), (3, "b")], "k int, v string")
    assert [tuple(r) for r in integrity.duplicate_keys(df, ["k", "v"]).collect()] == [(2, "a", 2)]
    assert integrity.duplicate_keys(df, ["k", "v"], nulls_distinct=False).count() == 2
    assert integrity.duplicate_keys(df.limit(0), ["k"]).count() == 0
    assert {tuple(r) for r in integrity.null_keys(df, ["k", "v"]).collect()} == {("k", 0), ("v", 2)}


def test_orphans_pass_over_null_keys(spark):
    child = spark.createDataFrame([(1, 1), (2, None), (3, 9)], "id int, p int")
    parent = spark.createDataFrame([(1,), (1,)], "p int")
    assert [r[0] for r in integrity.orphans(child, parent, [("p", "p")]).collect()] == [3]


def test_overlaps_in_one_sort(spark):
    rows = [(1, "a", 0, 10), (2, "a", 1, 2), (3, "a", 5, 6), (4, "a", 10, 12), (5, "b", 0, 1), (6, "a", 11, 11), (7, "a", 12, 13), (8, "a", 12, 14)]
    df = spark.createDataFrame(rows, "id int, k string, lo int, hi int")
    assert sorted(r[0] for r in integrity.overlapping(df, ["k"], "lo", "hi", "id").collect()) == [1, 2, 3, 7, 8]


def test_partitions(spark):
    df = spark.createDataFrame([(5,), (10,), (None,), (-1,)], "v int")
    name = partitions.range_partition(F.col("v"), {"low": (None, 0), "mid": (0, 10)}, "other")
    assert [r[0] for r in df.select(name).collect()] == ["mid", "other", "other", "low"]
    assert [r[0] for r in df.select(partitions.hash_partition(F.col("v"), 4)).collect()] == [1, 2, None, 3]
    with pytest.raises(ValueError):
        partitions.partition_ddl(spark, "t", 0)


def test_stored_buckets_are_refreshed_by_day(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    cagg = ContinuousAggregate("ts", "1 hour", ("event_type",), (F.count("*").alias("n"),))
    last = F.lit(events.agg(F.max("ts")).first()[0])
    store_buckets(cagg.query(events.filter(F.col("ts") < minus(last, "3 days"))), str(tmp_path / "b"))
    fresh = cagg.window_rows(events, minus(last, "10 days"), last + F.expr("INTERVAL '1' HOUR"))
    store_buckets(fresh.filter(F.col("bucket") >= F.date_trunc("DAY", minus(last, "5 days"))), str(tmp_path / "b"))
    assert sorted(map(tuple, load_buckets(spark, str(tmp_path / "b")).collect())) == sorted(map(tuple, cagg.query(events).collect()))


def test_chunks_on_disk(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    write_chunks(with_space(events, "user_id", 4), str(tmp_path / "c"), "ts", "7 days", ["space"], ["ts"])
    stored = spark.read.parquet(str(tmp_path / "c"))
    assert stored.count() == events.count() and len(list((tmp_path / "c").glob("chunk=*"))) == 5
    assert retained(events, "ts", "1 day", F.lit(datetime(2030, 1, 1))).count() == 0


def test_streams(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    counts = [F.count("*").alias("n")]
    whole = run_available(bucketed(stream_table(spark, str(tmp_path / "in"), 1), "ts", "1 hour", ["event_type"], counts, "60 days"))
    assert whole.agg(F.sum("n")).first()[0] == events.count()
    closed = run_available(bucketed(stream_table(spark, str(tmp_path / "in"), 16), "ts", "1 day", [], counts, "1 day"), "append", str(tmp_path / "ck"))
    assert 0 < closed.count() <= 30
    seen = []
    refresh_by_batch(bucketed(stream_table(spark, str(tmp_path / "in"), 1), "ts", "1 day", [], counts, "60 days"), lambda df, i: seen.append(df.count()), str(tmp_path / "ck2"))
    assert len(seen) >= 3


def test_retention_by_chunks_tells_the_scan(spark, sf_dir):
    from tessera.queries import QUERIES

    plan = QUERIES["retention_chunks"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024" in plan.split("PushedFilters")[1]
