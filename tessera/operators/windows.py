"""Ranges that are joined, sessions, and sliding windows out of shared panes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.time import as_interval, interval_parts, time_bucket

#: Rows of one bin that one task joins; bins with more are split.
BIN_ROWS = 200_000
#: Bins of a level are so many times as long as those of the level below.
STEP = 4
_MOMENT = "INTERVAL '0.000001' SECOND"


def range_join(ranges: DataFrame, points: DataFrame, lo: str, hi: str, at: str, width: str, keys: Sequence[str] = (), bin_rows: int = BIN_ROWS) -> DataFrame:
    """All pairs of a range and a point with equal ``keys`` and ``lo <= at < hi``, each once: a join on bins, never on all pairs.

    A range goes into the few bins that it meets, of a level whose bins are about as long as it is (``width`` times a power
    of ``STEP``), so a long one isn't cut into many; a point goes into its own bin of each level that there is. A pair meets
    in the bin that the point is in, and nowhere else. Bins with more than ``bin_rows`` points are split: a point goes
    into one part and a range into all. Nulls match nothing. Both sides' other columns must have different names.
    """
    months, seconds = interval_parts(width)
    if months or seconds <= 0:
        raise ValueError("bins have a fixed length")
    micros = round(seconds * 1_000_000)
    epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    since = lambda c: F.timestamp_diff("MICROSECOND", epoch, F.col(c).cast("timestamp_ntz"))
    length = (since(hi) - since(lo)).cast("double")
    level = F.greatest(F.lit(0), F.ceil(F.log(float(STEP), length / micros)).cast("int"))
    size = F.round(F.pow(F.lit(float(STEP)), F.col("_level"))).cast("long") * micros
    dealt = ranges.filter(F.col(lo) < F.col(hi)).withColumn("_level", level)
    levels = sorted(r["_level"] for r in dealt.select("_level").distinct().collect()) or [0]  # powers of STEP, so some thirty at most
    dealt = dealt.withColumn("_bin", F.explode(F.sequence(F.floor(since(lo) / size), F.floor((since(hi) - 1) / size))))
    there = points.filter(F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(*map(F.lit, levels)))).withColumn("_bin", F.floor(since(at) / size))
    by = ["_level", "_bin", *keys]
    full = there.groupBy(*by).count().filter(F.col("count") > bin_rows).select(*(F.col(c).alias(f"_f{c}") for c in by), F.ceil(F.col("count") / bin_rows).cast("int").alias("_parts"))
    met = [F.col(c) == F.col(f"_f{c}") for c in by]
    split = lambda df: df.join(full, met, "left").drop(*(f"_f{c}" for c in by)).withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    dealt = split(dealt).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    there = split(there).withColumn("_part", F.pmod(F.xxhash64(*(F.col(c) for c in points.columns)), F.col("_parts")).cast("int")).drop("_parts")
    pairs = dealt.join(there, [*by, "_part"])
    return pairs.filter((F.col(lo) <= F.col(at)) & (F.col(at) < F.col(hi))).drop("_level", "_bin", "_part")


def range_sums(ranges: DataFrame, points: DataFrame, lo: str, hi: str, at: str, pane: str, sums: Mapping[str, Column], last: str) -> DataFrame:
    """(lo, hi, sums, last): of each different range what the points with ``lo <= at < hi`` sum up to, and the last of their times.

    Points are summed up once, by panes of the length ``pane`` times powers of ``STEP``, and a range is put together of the longest panes that
    are whole within it, some ``2 * STEP`` of each length; so the work grows with the ranges and with the points, not with their pairs.
    Only points in a pane that a range begins or ends inside of are joined with it one by one. ``sums`` names what is summed up (a count is a
    sum of ones); sums are added up, never subtracted, so nothing of their precision is lost. Ranges without a point have no row.
    """
    months, seconds = interval_parts(pane)
    if months or seconds <= 0:
        raise ValueError("panes have a fixed length")
    micros = round(seconds * 1_000_000)
    epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    since = lambda c: F.timestamp_diff("MICROSECOND", epoch, F.col(c).cast("timestamp_ntz"))
    after = lambda n: F.expr(f"TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(({n}) * {micros} AS decimal(24, 6)) / 1000000)")
    named = dict(zip((f"_s{k}" for k in range(len(sums))), sums))
    rows = points.filter(F.col(at).isNotNull()).select(F.col(at).alias("_at"), *(sums[n].alias(c) for c, n in named.items()))
    whole = ranges.filter(F.col(lo) < F.col(hi)).select(F.col(lo).alias("_lo"), F.col(hi).alias("_hi")).distinct()
    whole = whole.withColumns({"_first": F.ceil(since("_lo") / micros), "_end": F.floor(since("_hi") / micros)})
    longest = whole.agg(F.max(F.col("_end") - F.col("_first"))).first()[0] or 0
    levels = 1
    while STEP**levels <= longest:
        levels += 1
    panes = base = rows.groupBy(F.floor(since("_at") / micros).alias("_pane")).agg(*(F.sum(c).alias(c) for c in named), F.max("_at").alias("_last")).withColumn("_level", F.lit(0))
    for level in range(1, levels):
        base = base.groupBy(F.floor(F.col("_pane") / STEP).alias("_pane")).agg(*(F.sum(c).alias(c) for c in named), F.max("_last").alias("_last")).withColumn("_level", F.lit(level))
        panes = panes.unionByName(base)
    # from both ends, those that no pane of the next length holds; then go on with panes of that length
    parts, span = [], whole.filter(F.col("_first") < F.col("_end"))
    first, end = F.col("_first"), F.col("_end")
    for level in range(levels):
        up, down = (F.ceil(first / STEP) * STEP, F.floor(end / STEP) * STEP) if level + 1 < levels else (end, end)
        # where no whole longer pane is left between the two, all are taken at this length
        none = up >= down
        left, right = F.when(none, end).otherwise(up), F.when(none, end).otherwise(down)
        run = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
        own = F.lit(level).alias("_level")
        parts.append(F.transform(F.concat(run(first, left), run(right, end)), lambda x: F.struct(own, x.alias("_pane"))))  # noqa: B023
        first, end = F.when(none, 0).otherwise(F.floor(up / STEP)).cast("bigint"), F.when(none, 0).otherwise(F.floor(down / STEP)).cast("bigint")
    pieces = span.select("_lo", "_hi", F.explode(F.concat(*parts)).alias("_p")).select("_lo", "_hi", "_p.*")
    values = ["_lo", "_hi", *named, "_last"]
    met = pieces.join(panes, ["_level", "_pane"]).select(*values)
    # what is left before the first whole pane and after the last one
    inner = whole.withColumns({"_from": after("_first"), "_to": after("_end")})
    apart = F.col("_first") > F.col("_end")
    head = inner.select("_lo", "_hi", F.col("_lo").alias("_a"), F.when(apart, F.col("_hi")).otherwise(F.col("_from").cast(dict(whole.dtypes)["_lo"])).alias("_b"))
    tail = inner.filter(~apart).select("_lo", "_hi", F.col("_to").cast(dict(whole.dtypes)["_hi"]).alias("_a"), F.col("_hi").alias("_b"))
    edges = head.unionByName(tail).filter(F.col("_a") < F.col("_b"))
    if not edges.isEmpty():
        met = met.unionByName(range_join(edges, rows, "_a", "_b", "_at", pane).withColumn("_last", F.col("_at")).select(*values))
    return met.groupBy(F.col("_lo").alias(lo), F.col("_hi").alias(hi)).agg(*(F.sum(c).alias(n) for c, n in named.items()), F.max("_last").alias(last))


def overlap_join(left: DataFrame, right: DataFrame, lo: tuple[str, str], hi: tuple[str, str], width: str, keys: Sequence[str] = ()) -> DataFrame:
    """All pairs of half-open ranges that overlap, each once: one range begins in the other. So those of the right that begin within
    the left are a join of ranges with points, and those of the left that begin within the right, but not at the same time, are another."""
    one = range_join(left, right.filter(F.col(lo[1]) < F.col(hi[1])), lo[0], hi[0], lo[1], width, keys)
    other = range_join(right.withColumn("_after", F.col(lo[1]) + F.expr(_MOMENT)).filter(F.col("_after") < F.col(hi[1])), left.filter(F.col(lo[0]) < F.col(hi[0])), "_after", hi[1], lo[0], width, keys)
    return one.unionByName(other.select(*one.columns))


def sessions(df: DataFrame, keys: Sequence[str], ts: str, gap: str, sums: Mapping[str, Column], slab: str = "1 day") -> DataFrame:
    """(keys, session_start, last_ts, sums): rows of a key of which each is at most ``gap`` after the one before.

    Sessions are merged within each ``slab`` of time by itself, so a key with very many rows is many tasks' work; those that
    begin or end within ``gap`` of their slab's border, two of a slab at most, are then put together across slabs. ``sums`` names what is
    summed up (a count is a sum of ones). Rows without a time are in no session.
    """
    wait, length = interval_parts(gap), interval_parts(slab)
    if wait[0] or length[0] or not 0 < wait[1] <= length[1]:
        raise ValueError("the gap must be of a fixed length, and a slab of at least that")
    rows = df.filter(F.col(ts).isNotNull()).withColumns({"_slab": time_bucket(slab, ts), "_ts": F.col(ts).cast("timestamp_ntz")})
    grouped = rows.groupBy(*keys, "_slab", F.session_window("_ts", f"{round(wait[1] * 1_000_000)} microseconds").alias("_session"))
    local = grouped.agg(F.min("_ts").alias("session_start"), F.max("_ts").alias("last_ts"), *(F.sum(c).alias(n) for n, c in sums.items()))
    edge = (F.col("session_start") <= F.col("_slab") + as_interval(gap)) | (F.col("last_ts") + as_interval(gap) >= F.col("_slab") + as_interval(slab))
    columns = [*keys, "session_start", "last_ts", *sums]
    along = W.partitionBy(*keys).orderBy("session_start")
    fresh = F.coalesce(F.col("session_start") > F.lag("last_ts").over(along) + as_interval(gap), F.lit(True)).cast("int")
    across = local.filter(edge).withColumn("_fresh", fresh).withColumn("_n", F.sum("_fresh").over(along)).groupBy(*keys, "_n")
    whole = across.agg(F.min("session_start").alias("session_start"), F.max("last_ts").alias("last_ts"), *(F.sum(n).alias(n) for n in sums))
    return local.filter(~edge).select(*columns).unionByName(whole.select(*columns))


def sliding(df: DataFrame, keys: Sequence[str], ts: str, width: str, slide: str, sums: Mapping[str, Column]) -> DataFrame:
    """(keys, window_start, sums): of each window of ``width`` that begins at a multiple of ``slide`` and has a row.

    Rows are summed up once, by panes of ``slide``; a window is the sum of its panes. So a row isn't copied into the windows that it is
    in, a pane is. ``width`` is a multiple of ``slide``; ``sums`` names what is summed up (a count is a sum of ones).
    """
    w, s = interval_parts(width)[1], interval_parts(slide)[1]
    if not s or w % s or interval_parts(width)[0] or interval_parts(slide)[0]:
        raise ValueError("the width must be a multiple of the slide, both of a fixed length")
    panes = df.filter(F.col(ts).isNotNull()).groupBy(*keys, time_bucket(slide, ts).alias("_pane")).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    starts = F.sequence(F.col("_pane") - as_interval(f"{w - s} seconds"), F.col("_pane"), as_interval(slide))
    return panes.withColumn("window_start", F.explode(starts)).groupBy(*keys, "window_start").agg(*(F.sum(n).alias(n) for n in sums))
