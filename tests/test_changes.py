"""Refresh by what changed, compressed chunks, ordered runs and merged ranges: mechanisms, odd rows, plans."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera import storage
from tessera.operators.compression import CompressedTable, Layout, compress, decompress, may_have
from tessera.operators.invalidation import Materialization
from tessera.operators.runs import first_of_each, merged_ranges, numbered, runs, sort_within_runs
from tessera.operators.timeseries import ContinuousAggregate
from tessera.sources.ddl import parse

T0 = datetime(2024, 1, 1)
READINGS = "id int, ts timestamp_ntz, device string, value double"


def readings(spark, rows):
    return spark.createDataFrame(rows, READINGS)


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def some_readings(n=400, days=40, seed=1):
    r = random.Random(seed)
    rows = [(i, T0 + timedelta(minutes=r.randrange(days * 1440)), r.choice(["a", "b", None]), r.choice([None, r.random()])) for i in range(n)]
    return [*rows, (n, None, "a", 1.0), (n + 1, None, None, None)]


@pytest.fixture(scope="module")
def hourly(spark):
    return ContinuousAggregate("ts", "1 hour", ("device",), (F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.max("id").alias("last")))


def content(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def full(hourly, rows):
    return content(hourly.query(rows.filter("ts IS NOT NULL")))


def test_refresh_follows_inserts_changes_and_deletes(spark, hourly, tmp_path):
    rows = some_readings()
    made = Materialization(spark, hourly, str(tmp_path / "cagg"), slab="7 days")
    before = readings(spark, rows)
    made.create(before.filter("ts IS NOT NULL"))
    assert content(made.buckets()) == full(hourly, before) and made.pending().count() == 0
    assert made.refresh(before).count() == 0

    gone, changed = rows[:40], rows[40:60]
    moved = [(i, t + timedelta(days=3), d, 5.0) for i, t, d, _ in changed]
    new = [(1_000 + i, T0 + timedelta(days=100, minutes=7 * i), "c", 1.0) for i in range(50)]  # after all that was stored
    after = readings(spark, rows[60:] + moved + new)
    for part in (gone, changed, moved, new):
        made.invalidate(readings(spark, part))
    assert content(made.real_time(after.filter("ts IS NOT NULL"))) == full(hourly, after)
    touched = {t.replace(minute=0) for _, t, *_ in gone + changed + moved + new if t}
    redone = {r.bucket for r in made.refresh(after).collect()}
    assert redone == touched and content(made.buckets()) == full(hourly, after)
    assert made.pending().count() == 0 and made.refresh(after).count() == 0


def test_days_without_rows_vanish_and_other_days_keep_their_files(spark, hourly, tmp_path):
    path = tmp_path / "cagg"
    made = Materialization(spark, hourly, str(path))
    rows = readings(spark, [(i, T0 + timedelta(hours=6 * i), "a", 1.0) for i in range(12)])
    made.create(rows)
    files = {p for p in path.glob("buckets/day=*/*.parquet")}
    left = rows.filter(F.col("id").isin(0, 4, 5, 6, 7, 8, 9, 10, 11))  # of the first day one is left
    made.invalidate(rows.filter("id IN (1, 2, 3)"))
    made.refresh(left)
    assert content(made.buckets()) == full(hourly, left)
    kept = {p for p in path.glob("buckets/day=*/*.parquet")}
    assert {p for p in files if "2024-01-01" not in str(p)} <= kept
    made.invalidate(rows.filter("id IN (4, 5, 6, 7)"))
    made.refresh(rows.filter("id = 0 OR id > 7"))
    assert not (path / "buckets/day=2024-01-02").exists() and made.buckets().count() == 5


def test_a_window_leaves_the_rest_in_the_log(spark, hourly, tmp_path):
    rows = readings(spark, [(i, T0 + timedelta(minutes=20 * i), "a", 1.0) for i in range(72)])
    made = Materialization(spark, hourly, str(tmp_path / "cagg"))
    made.create(rows, with_data=False)
    assert made.buckets().count() == 0 and [tuple(r) for r in made.pending().collect()] == [(T0, T0 + timedelta(days=1))]
    start, end = (F.lit(s).cast("timestamp_ntz") for s in ("2024-01-01 05:10:00", "2024-01-01 08:50:00"))
    assert sorted(r.bucket.hour for r in made.refresh(rows, start, end).collect()) == [6, 7]
    assert sorted((r.lo.hour, r.hi.hour) for r in made.pending().collect()) == [(0, 6), (8, 0)]
    assert {r.n for r in made.buckets().collect()} == {3}
    made.refresh(rows, None, start)
    made.refresh(rows, start)
    assert [(r.lo.hour, r.hi.hour) for r in made.pending().collect()] == [(5, 6)]  # whole in neither window
    made.refresh(rows)
    assert content(made.buckets()) == full(hourly, rows) and made.pending().count() == 0


def test_a_broken_off_refresh_is_done_again(spark, hourly, tmp_path, monkeypatch):
    rows = readings(spark, some_readings(60)).filter("ts IS NOT NULL")
    made = Materialization(spark, hourly, str(tmp_path / "cagg"))
    made.create(rows.filter("id % 2 = 0"))
    made.invalidate(rows.filter("id % 2 = 1"))
    from tessera.operators import invalidation

    with monkeypatch.context() as m:
        m.setattr(invalidation, "store_buckets", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            made.refresh(rows)
    assert made.pending().count() > 0
    made.refresh(rows)
    assert content(made.buckets()) == full(hourly, rows)


def test_a_refresh_tells_the_scan_its_ranges(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    made = Materialization(spark, ContinuousAggregate("ts", "1 hour", (), (F.count("*").alias("n"),)), str(tmp_path / "cagg"))
    made.create(events)
    made.invalidate(events.filter("event_id = 77"))
    ranges = made.pending()
    text = plan(made._within(events.filter(made._bounds(ranges, "ts")), F.col("ts"), ranges))
    pushed = next(line for line in text.splitlines() if "PushedFilters" in line and "ts" in line)
    assert "GreaterThanOrEqual(ts,2024" in pushed and "LessThan(ts,2024" in pushed
    assert "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("slab", ["1 day", "7 days", "1 month"])
def test_merged_ranges_are_those_of_a_sweep(spark, slab):
    r = random.Random(8)
    rows = [(r.choice("xy"), T0 + timedelta(hours=a), T0 + timedelta(hours=a + r.choice([0, 1, 1, 2, 5, 30, 400]))) for a in (r.randrange(3_000) for _ in range(120))]
    rows += [("x", None, T0), ("y", T0, None), ("z", T0, T0), (None, T0, T0 + timedelta(days=60)), (None, T0 + timedelta(days=60), T0 + timedelta(days=61)), rows[0]]
    want = []
    for key in {k for k, *_ in rows}:
        spans = sorted((a, b) for k, a, b in rows if k == key and a and b and a < b)
        out: list = []
        for a, b in spans:
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        want += [(key, a, b) for a, b in out]
    df = spark.createDataFrame(rows, "k string, a timestamp_ntz, b timestamp_ntz")
    assert sorted(map(repr, (tuple(x) for x in merged_ranges(df, "a", "b", slab, ["k"]).collect()))) == sorted(map(repr, want))
    assert merged_ranges(df.limit(0), "a", "b", slab).collect() == []


# ---- compression


LAYOUTS = [Layout("ts", "7 days", ("device",), (("ts", True), ("id", False)), 7), Layout("ts", "1 month", (), (("value", False), ("ts", False)), 10), Layout("ts", "30 days", ("device", "value"), (), 1_000)]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_what_is_compressed_comes_back(spark, layout):
    rows = readings(spark, some_readings() + some_readings()[:30])
    batches = compress(rows, layout)
    assert content(decompress(batches, layout, rows.columns)) == content(rows)
    sizes = batches.groupBy("chunk", *layout.segment_by).agg(F.sum("n").alias("n"), F.count("*").alias("b"), F.max("n").alias("m")).collect()
    assert all(r.m <= layout.batch and r.b == -(-r.n // layout.batch) for r in sizes) and sum(r.n for r in sizes) == rows.count()
    assert compress(rows.limit(0), layout).count() == 0 and decompress(compress(rows.limit(0), layout), layout, rows.columns).collect() == []
    some = decompress(batches, layout, ["id", "ts"], None, F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-12").cast("timestamp_ntz"))
    assert content(some) == content(rows.filter("ts >= '2024-01-10' AND ts < '2024-01-12'").select("id", "ts"))


def test_batches_are_in_the_declared_order(spark):
    layout = LAYOUTS[0]
    rows = [r for r in some_readings() if r[1]]
    got = compress(readings(spark, rows), layout).filter("device = 'a'").orderBy("chunk", "batch").collect()
    ids = [i for b in got for i in b["id"]]
    chunk = lambda t: (t - datetime(2000, 1, 3)).days // 7
    want = sorted((r for r in rows if r[2] == "a"), key=lambda r: (chunk(r[1]), -r[1].timestamp(), r[0]))
    assert ids == [r[0] for r in want]
    assert all(min(b.ts.offsets) == 0 and b.min_ts <= b.max_ts for b in got)


def test_a_time_filter_opens_fewer_batches(spark, tmp_path):
    layout = Layout("ts", "30 days", (), (("ts", False),), 20)
    compress(readings(spark, [(i, T0 + timedelta(minutes=10 * i), "a", 1.0) for i in range(2_000)]), layout).write.parquet(str(tmp_path / "b"))
    batches = spark.read.parquet(str(tmp_path / "b"))
    since, until = (F.lit(s).cast("timestamp_ntz") for s in ("2024-01-05", "2024-01-06"))
    assert may_have(batches, layout, since, until).count() <= 9 < batches.count()
    rows = decompress(batches, layout, ["id"], None, since, until)
    text = plan(rows)
    pushed = next(line for line in text.splitlines() if "PushedFilters" in line)
    assert "GreaterThanOrEqual(max_ts,2024" in pushed and "LessThan(min_ts,2024" in pushed
    read = next(line for line in text.splitlines() if "ReadSchema" in line)
    assert "value" not in read and "device" not in read and rows.count() == 144


def test_a_compressed_table_takes_late_rows_and_recovers(spark, tmp_path, monkeypatch):
    rows = readings(spark, some_readings())
    table = CompressedTable(spark, str(tmp_path / "t"), Layout("ts", "7 days", ("device",), (), 50))
    table.create(rows)
    assert table.read().count() == 0 and table.compress() == []
    table.insert(rows.filter("id % 3 > 0"))
    assert len(table.compress()) == rows.filter("ts IS NOT NULL").selectExpr("date_trunc('week', ts)").distinct().count()
    table.insert(rows.filter("id % 3 = 0"))
    assert content(table.read()) == content(rows)
    # age: only chunks that ended long enough ago
    done = table.compress(F.lit("2024-01-20").cast("timestamp_ntz"), "5 days")
    assert done == ["2024-01-01 00.00.00", "2024-01-08 00.00.00"] and content(table.read()) == content(rows)
    # broken off once the new batches are there: finished by the next writer, before its own rows
    with monkeypatch.context() as m:
        calls = []
        real = CompressedTable.recover
        m.setattr(CompressedTable, "recover", lambda self: real(self) if not calls.append(1) and len(calls) == 1 else (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.compress()
    assert storage.exists(spark, f"{table.path}/ready")
    table.insert(rows.filter("id = 5"))
    assert not storage.exists(spark, f"{table.path}/ready")
    assert content(table.read()) == content(rows.unionByName(rows.filter("id = 5")))
    since = F.lit("2024-01-15").cast("timestamp_ntz")
    assert content(table.read(["device", "id"], since)) == content(rows.unionByName(rows.filter("id = 5")).filter("ts >= '2024-01-15'").select("device", "id"))


def test_layouts_are_declared(spark):
    catalog = parse("""
        CREATE TABLE m (time timestamptz NOT NULL, device text, v double precision);
        SELECT create_hypertable('m', 'time', chunk_time_interval => INTERVAL '1 day');
        ALTER TABLE m SET (timescaledb.compress, timescaledb.compress_segmentby = 'device', timescaledb.compress_orderby = 'time DESC, v');
    """)
    assert Layout.declared(catalog, "public", "m") == Layout("time", "1 day", ("device",), (("time", True), ("v", False)))
    with pytest.raises(ValueError):
        Layout.declared(catalog, "public", "other")


# ---- order


def test_numbers_in_blocks_are_those_of_one_window(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", None]), r.choice([None, *range(50)]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t int, id int")
    got = {x.id: x.n for x in numbered(df, ["k"], F.expr("t div 7"), [F.col("t").asc_nulls_first(), F.col("id")]).collect()}
    for key in ("a", None):
        mine = sorted((x for x in rows if x[0] == key), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        assert [got[x[2]] for x in mine] == list(range(1, len(mine) + 1))
    assert numbered(df.limit(0), ["k"], F.col("t"), [F.col("id")]).count() == 0


def test_runs_and_order_within_them(spark):
    values = ["x", "x", None, None, "x", "y", "y", "y", "x"]
    df = spark.createDataFrame([("k", i, v, i % 3) for i, v in enumerate(values)] + [(None, 0, "x", 0)], "k string, t int, v string, p int")
    got = sorted((r.t, r.run, r.place) for r in runs(df, ["k"], ["t"], "v").filter("k = 'k'").collect())
    assert got == [(0, 1, 1), (1, 1, 2), (2, 2, 1), (3, 2, 2), (4, 3, 1), (5, 4, 1), (6, 4, 2), (7, 4, 3), (8, 5, 1)]
    placed = sorted((r.position, r.t) for r in sort_within_runs(df, ["k"], ["t"], "v", [F.col("p").desc()]).filter("k = 'k'").collect())
    assert [t for _, t in placed] == [1, 0, 2, 3, 4, 5, 7, 6, 8]
    assert runs(df.limit(0), ["k"], ["t"], "v").columns == ["k", "t", "v", "p", "place", "run"]


def test_the_first_of_each_are_cut_before_the_shuffle(spark):
    df = spark.range(10_000).selectExpr("id % 3 AS k", "id AS v")
    top = first_of_each(df, ["k"], [F.col("v").desc()], 2)
    assert sorted((r.k, r.v, r["rank"]) for r in top.collect()) == [(0, 9996, 2), (0, 9999, 1), (1, 9994, 2), (1, 9997, 1), (2, 9995, 2), (2, 9998, 1)]
    text = df._jdf and top._jdf.queryExecution().executedPlan().toString()
    below = text[text.index("Exchange hashpartitioning") :]
    assert "WindowGroupLimit" in below and "Partial" in below
