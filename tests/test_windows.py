"""Range joins, sessions, sliding windows, declared functions and streams: odd rows, plans, restarts."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.functions.routines import install, parameters, spark_ddl, spark_type
from tessera.operators.windows import overlap_join, range_join, range_sums, sessions, sliding
from tessera.sources.ddl import parse
from tessera.sources.lexer import SqlError
from tessera.streaming.late import added_files, append_to_files, closed_buckets, compact_versions, dropped_rows, first_deliveries, latest, upsert_versions

T0 = datetime(2024, 1, 1)
at = lambda minutes: None if minutes is None else T0 + timedelta(minutes=minutes)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bin_rows", [3, 1_000])
@pytest.mark.parametrize("width", ["1 minute", "90 minutes"])
def test_range_join_is_that_of_all_pairs(spark, bin_rows, width):
    r = random.Random(2)
    ranges = [(i, r.choice(["k", "l", None]), s, s + r.choice([-5, 0, 1, 3, 60, 1_000, 100_000])) for i, s in enumerate(r.choices(range(-300, 4_000), k=80))]
    ranges += [(80, "k", None, 10), (81, "k", 10, None)]
    points = [(i, r.choice(["k", "l", None]), p) for i, p in enumerate([*r.choices(range(-300, 4_500), k=120), *[500] * 40, None])]
    left = spark.createDataFrame([(i, k, at(a), at(b)) for i, k, a, b in ranges], "r int, k string, lo timestamp_ntz, hi timestamp_ntz")
    right = spark.createDataFrame([(i, k, at(p)) for i, k, p in points], "p int, k string, ts timestamp_ntz")
    got = sorted((x.r, x.p) for x in range_join(left, right, "lo", "hi", "ts", width, ["k"], bin_rows).collect())
    want = sorted((i, j) for i, k, a, b in ranges for j, l, p in points if None not in (a, b, p, k) and k == l and a <= p < b)
    assert got == want and len(want) > 200
    assert range_join(left.limit(0), right, "lo", "hi", "ts", width, ["k"]).count() == 0 and range_join(left, right.limit(0), "lo", "hi", "ts", width, ["k"]).count() == 0
    free = range_join(left, right.drop("k"), "lo", "hi", "ts", width)
    assert free.count() == sum(None not in (a, b, p) and a <= p < b for _, _, a, b in ranges for *_, p in points)
    assert "NestedLoop" not in plan(free) and "Cartesian" not in plan(free)


def test_overlaps_are_those_of_all_pairs(spark):
    r = random.Random(6)
    rows = lambda n: [(i, r.choice("kl"), s, s + r.choice([-1, 0, 1, 5, 200])) for i, s in enumerate(r.choices(range(400), k=n))]
    a, b = rows(60), [*rows(60), (60, "k", None, 5)]
    left = spark.createDataFrame([(i, k, at(x), at(y)) for i, k, x, y in a], "a int, k string, a_lo timestamp_ntz, a_hi timestamp_ntz")
    right = spark.createDataFrame([(i, k, at(x), at(y)) for i, k, x, y in b], "b int, k string, b_lo timestamp_ntz, b_hi timestamp_ntz")
    got = sorted((x.a, x.b) for x in overlap_join(left, right, ("a_lo", "b_lo"), ("a_hi", "b_hi"), "10 minutes", ["k"]).collect())
    assert got == sorted((i, j) for i, k, x, y in a for j, l, v, w in b if None not in (v, w) and k == l and x < y and v < w and x < w and v < y)


def test_sessions_end_after_the_gap(spark):
    rows = [("a", 0), ("a", 60), ("a", 121), ("a", 178), ("a", 178), ("b", 5), (None, 1), (None, 2), ("a", None)]
    df = spark.createDataFrame([(k, at(m), 1) for k, m in rows], "k string, ts timestamp_ntz, v int")
    ones = {"n": F.lit(1)}
    got = {(r.k, r.session_start, r.last_ts, r.n) for r in sessions(df, ["k"], "ts", "1 hour", ones).collect()}
    assert got == {("a", at(0), at(60), 2), ("a", at(121), at(178), 3), ("b", at(5), at(5), 1), (None, at(1), at(2), 2)}
    assert sessions(df.limit(0), ["k"], "ts", "1 hour", ones).count() == 0
    with pytest.raises(ValueError):
        sessions(df, ["k"], "ts", "1 hour", ones, "30 minutes")


@pytest.mark.parametrize("slab", ["1 hour", "5 hours", "30 days"])
def test_sessions_cross_slabs(spark, slab):
    r = random.Random(3)
    rows = [(r.choice("ab"), r.randrange(6_000)) for _ in range(250)] + [("c", 30 * i) for i in range(100)] + [("d", 60 * i) for i in range(40)]
    want = set()
    for key in "abcd":
        times = sorted(m for k, m in rows if k == key)
        session = [times[0]]
        for m in [*times[1:], 10**6]:
            if m - session[-1] > 60:
                want.add((key, at(session[0]), at(session[-1]), len(session)))
                session = []
            session.append(m)
    df = spark.createDataFrame([(k, at(m)) for k, m in rows], "k string, ts timestamp_ntz")
    assert {(x.k, x.session_start, x.last_ts, x.n) for x in sessions(df, ["k"], "ts", "1 hour", {"n": F.lit(1)}, slab).collect()} == want


def test_windows_are_sums_of_panes(spark):
    r = random.Random(1)
    rows = [(r.choice("ab"), r.choice([*range(600), None]), r.choice([None, 1.0, 2.5])) for _ in range(200)]
    df = spark.createDataFrame([(k, at(m), v) for k, m, v in rows], "k string, ts timestamp_ntz, v double")
    made = sliding(df, ["k"], "ts", "1 hour", "15 minutes", {"n": F.lit(1), "total": F.col("v")})
    want: dict = {}
    for k, m, v in rows:
        for s in [] if m is None else range(m // 15 * 15 - 45, m // 15 * 15 + 1, 15):
            n, t = want.get((k, at(s)), (0, None))
            want[k, at(s)] = (n + 1, t if v is None else (t or 0) + v)
    assert {(x.k, x.window_start): (x.n, x.total) for x in made.collect()} == want
    text = plan(made)
    assert text.index("Generate explode") < text.rindex("HashAggregate")  # panes are copied into windows, rows are not
    assert sliding(df.limit(0), ["k"], "ts", "1 hour", "15 minutes", {"n": F.lit(1)}).count() == 0
    with pytest.raises(ValueError):
        sliding(df, ["k"], "ts", "1 hour", "25 minutes", {"n": F.lit(1)})


# ---- functions


def test_types_and_parameters():
    assert [spark_type(t) for t in ("numeric(10, 2)", "character varying(20)", "timestamp with time zone", "integer[]", "DOUBLE PRECISION", "numeric")] == ["DECIMAL(10, 2)", "STRING", "TIMESTAMP", "ARRAY<INT>", "DOUBLE", "DECIMAL(38,18)"]
    assert parameters("a integer, b numeric(10, 2) DEFAULT 1.5, double precision, IN d text = 'x'") == [("a", "INT", None), ("b", "DECIMAL(10, 2)", "1.5"), ("_3", "DOUBLE", None), ("d", "STRING", "'x'")]
    for bad in ("OUT a integer", "a money"):
        with pytest.raises(SqlError):
            parameters(bad)


def test_declared_functions_are_part_of_the_plan(spark):
    spark.createDataFrame([(1, "a", 5.0), (2, "b", 7.0), (3, "a", 9.0)], "id long, kind string, v double").createOrReplaceTempView("prices")
    names = install(spark, """
        CREATE FUNCTION add_tax(price numeric(10,2), rate numeric(4,2) DEFAULT 0.2) RETURNS numeric(12,2) LANGUAGE sql IMMUTABLE RETURN price * (1 + rate);
        CREATE FUNCTION label(text, integer) RETURNS text LANGUAGE sql STRICT AS $$ SELECT upper($1) || '-' || $2::character varying(9) || CAST('::text' AS text) $$;
        CREATE FUNCTION dearest(least_price double precision) RETURNS double precision LANGUAGE sql AS $$ SELECT max(v) FROM prices WHERE v >= least_price; $$;
        CREATE FUNCTION of_kind(wanted text) RETURNS TABLE (id bigint, v double precision) LANGUAGE sql AS $$ SELECT p.id, p.v FROM prices p WHERE p.kind = wanted $$;
    """)
    assert names == ["add_tax", "label", "dearest", "of_kind"]
    spark.createDataFrame([("a",), ("c",), (None,)], "kind string").createOrReplaceTempView("kinds")
    install(spark, parse("CREATE FUNCTION of_kind(wanted text) RETURNS TABLE (id bigint, v double precision) LANGUAGE sql AS $$ SELECT p.id, p.v FROM prices p WHERE p.kind = wanted $$").rows["functions"])
    assert [float(x) for x in spark.sql("SELECT add_tax(10), add_tax(10, 0.5)").first()] == [12.0, 15.0]
    assert tuple(spark.sql("SELECT label('x', 3), label(NULL, 3), dearest(6)").first()) == ("X-3::text", None, 9.0)
    rows = spark.sql("SELECT kinds.kind, id, v FROM kinds, LATERAL of_kind(kinds.kind)")
    assert sorted(tuple(r) for r in rows.collect()) == [("a", 1, 5.0), ("a", 3, 9.0)]
    assert "Join" in plan(rows) and "NestedLoop" not in plan(rows) and "Python" not in plan(rows)
    with pytest.raises(SqlError):
        spark_ddl({"name": "f", "language": "plpgsql", "args": "", "returns": "integer", "body": "BEGIN END"})
    with pytest.raises(SqlError):
        spark_ddl({"name": "f", "language": "sql", "args": "", "returns": "SETOF prices", "body": "SELECT 1"})


# ---- streams


SCHEMA = "id int, ts timestamp_ntz, v double"


def deliver(spark, source, rows):
    spark.createDataFrame([(i, at(m), v) for i, m, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(source)


def test_late_rows_are_dropped_and_state_goes(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    spark.createDataFrame([], SCHEMA).write.parquet(source)
    run = lambda: append_to_files(closed_buckets(added_files(spark, source, SCHEMA), "ts", "1 hour", [], [F.count("*").alias("n")], "30 minutes"), out, checkpoint)
    deliver(spark, source, [(1, 10, 1.0), (2, 50, 1.0), (3, 100, 1.0), (9, None, 1.0)])  # mark 70: the first hour is closed
    run()
    got = lambda: sorted((r.bucket, r.n) for r in spark.read.parquet(out).collect())
    assert got() == [(at(0), 2)]
    deliver(spark, source, [(4, 59, 1.0), (5, 65, 1.0), (6, 300, 1.0)])  # 59 is behind, 65 isn't
    progress = run()
    assert dropped_rows(progress) == 1 and got() == [(at(0), 2), (at(60), 2)]
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 1  # the hour of 300 alone is remembered
    assert all(p["numInputRows"] == 0 for p in run())  # nothing new, nothing twice
    assert got() == [(at(0), 2), (at(60), 2)]


def test_rows_that_come_twice_come_out_once(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    spark.createDataFrame([], SCHEMA).write.parquet(source)
    run = lambda: append_to_files(first_deliveries(added_files(spark, source, SCHEMA), ["id"], "ts", "1 hour"), out, checkpoint)
    deliver(spark, source, [(1, 10, 1.0), (1, 10, 1.0), (2, 20, 1.0)])
    run()
    deliver(spark, source, [(1, 10, 1.0), (3, 30, 1.0), (4, 500, 1.0)])
    run()
    deliver(spark, source, [(2, 20, 1.0), (5, 430, 1.0), (5, 445, 1.0), (5, 445, 1.0)])
    progress = run()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4, 5] and dropped_rows(progress) == 2
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] < 5


def test_versions_are_upserted(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    spark.createDataFrame([], SCHEMA).write.parquet(source)
    run = lambda: upsert_versions(closed_buckets(added_files(spark, source, SCHEMA), "ts", "1 hour", [], [F.count("*").alias("n")], "1 day"), out, checkpoint)
    for rows in ([(1, 10, 1.0), (2, 70, 1.0)], [(3, 20, 1.0)], [(4, 75, 1.0), (5, 130, 1.0)]):
        deliver(spark, source, rows)
        run()
    want = [(at(0), 2), (at(60), 2), (at(120), 1)]
    assert sorted((r.bucket, r.n) for r in latest(spark, out, ["bucket"]).collect()) == want and spark.read.parquet(out).count() == 5
    compact_versions(spark, out, ["bucket"], str(tmp_path / "small"))
    assert sorted((r.bucket, r.n) for r in latest(spark, str(tmp_path / "small"), ["bucket"]).collect()) == want


@pytest.mark.parametrize("unit", [1, 60])
def test_range_sums_are_those_of_all_pairs_without_making_them(spark, unit):
    rng, start = random.Random(unit), datetime(2024, 1, 1)
    at = lambda minutes: start + timedelta(seconds=minutes * unit)
    ranges = [(at(a), at(a + rng.choice([0, 1, 3, 59, 700]))) for a in (rng.randrange(3000) for _ in range(150))] + [(at(5), at(3)), (None, at(9)), (at(9), None)]
    points = [(at(rng.randrange(3600)), rng.choice([None, 1.25, 2.5])) for _ in range(400)] + [(at(700), 0.5)] * 30 + [(None, 9.0)]
    left, right = spark.createDataFrame(ranges, "lo timestamp_ntz, hi timestamp_ntz"), spark.createDataFrame(points, "ts timestamp_ntz, value double")
    got = range_sums(left, right, "lo", "hi", "ts", "1 minute", {"n": F.lit(1).cast("long"), "total": F.col("value")}, "last_ts")
    want = {}
    for lo, hi in ranges:
        inside = [(t, v) for t, v in points if lo and hi and t and lo <= t < hi]
        if inside:
            values = [v for _, v in inside if v is not None]
            want[lo, hi] = (len(inside), sum(values) if values else None, max(t for t, _ in inside))
    assert {(r.lo, r.hi): (r.n, r.total, r.last_ts) for r in got.collect()} == want and got.count() == len(want)
    assert range_sums(left.limit(0), right, "lo", "hi", "ts", "1 minute", {"n": F.lit(1)}, "last_ts").count() == 0
    assert range_sums(left, right.limit(0), "lo", "hi", "ts", "1 minute", {"n": F.lit(1)}, "last_ts").count() == 0
