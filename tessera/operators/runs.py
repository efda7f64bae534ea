"""Rows in order: numbering in blocks, runs of equal values (gaps and islands), merged ranges, the first k of a group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.time import as_interval, time_bucket


def _same(columns: Sequence[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(prefix + c)) for c in columns))


def numbered(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[Column], name: str = "n") -> DataFrame:
    """``df`` with the number, from 1, of each row within its ``keys``, in ``order``.

    ``block`` must rise with the order (null first): rows are numbered in each block by itself and moved on by the sizes
    of the blocks before, so that a key with very many rows is sorted by as many tasks as it has blocks.
    """
    rows = df.withColumn("_block", block)
    sizes = rows.groupBy(*keys, "_block").count()
    before = F.sum("count").over(W.partitionBy(*keys).orderBy(F.col("_block").asc_nulls_first())) - F.col("count")
    starts = sizes.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_block").alias("_k__block"), before.alias("_before"))
    inside = rows.withColumn(name, F.row_number().over(W.partitionBy(*keys, "_block").orderBy(*order)).cast("long"))
    met = inside.join(starts, _same([*keys, "_block"], "_k_"))
    return met.withColumn(name, F.col(name) + F.col("_before")).select(*df.columns, name)


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """``df`` with ``run``, the number of the run of equal neighbouring values within ``keys`` that a row belongs to (from 1),
    and ``place``, its number within that run (from 1). Nulls are equal. ``order`` must tell the rows of a key apart.

    The rows of one value stay side by side exactly as long as their number among all rows and their number among those of
    the value rise together, so the difference and the value name a run.
    """
    every, own = W.partitionBy(*keys).orderBy(*order), W.partitionBy(*keys, value).orderBy(*order)
    island = df.withColumn("_i", F.row_number().over(every)).withColumn("_d", F.col("_i") - F.row_number().over(own))
    placed = island.withColumns({"place": F.row_number().over(W.partitionBy(*keys, value, "_d").orderBy(*order)), "_first": F.min("_i").over(W.partitionBy(*keys, value, "_d"))})
    return placed.withColumn("run", F.dense_rank().over(W.partitionBy(*keys).orderBy("_first"))).drop("_i", "_d", "_first")


def sort_within_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, priority: Sequence[Column]) -> DataFrame:
    """``df`` with ``position``, from 1 within ``keys``: the rows in ``order``, but those of a run of equal ``value`` by ``priority``
    first. No row leaves its run, so what holds between the rows of different runs still does."""
    marked = runs(df, keys, order, value)
    return marked.withColumn("position", F.row_number().over(W.partitionBy(*keys).orderBy("run", *priority, *order))).drop("run", "place")


def merged_ranges(ranges: DataFrame, lo: str, hi: str, slab: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, lo, hi): the union of half-open time ranges of each key, as few as can be; empty ones vanish, touching ones join.

    Ranges are cut where a ``slab`` of time ends and merged inside each slab by itself, so one key's many ranges are many
    tasks' work; only what touches the border of a slab, two ranges of it at most, is then put together across slabs.
    """
    rows = ranges.select(*keys, F.col(lo).cast("timestamp_ntz").alias("lo"), F.col(hi).cast("timestamp_ntz").alias("hi")).filter("lo < hi")
    # equal begins are one before anything is shuffled
    rows = rows.groupBy(*keys, "lo").agg(F.max("hi").alias("hi"))
    last = time_bucket(slab, F.col("hi") - F.expr("INTERVAL '0.000001' SECOND"))
    cut = rows.withColumn("_slab", F.explode(F.sequence(time_bucket(slab, "lo"), last, as_interval(slab)))).withColumn("_next", F.col("_slab") + as_interval(slab))
    cut = cut.withColumns({"lo": F.greatest("lo", "_slab"), "hi": F.least("hi", "_next")})
    local = _islands(cut, [*keys, "_slab", "_next"])
    touches = (F.col("lo") == F.col("_slab")) | (F.col("hi") == F.col("_next"))
    across = _islands(local.filter(touches).select(*keys, "lo", "hi"), list(keys))
    return local.filter(~touches).select(*keys, "lo", "hi").unionByName(across.select(*keys, "lo", "hi"))


def _islands(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    along = W.partitionBy(*keys).orderBy("lo")
    reached = F.max("hi").over(along.rowsBetween(W.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.coalesce(F.col("lo") > reached, F.lit(True)).cast("int"))
    return marked.withColumn("_island", F.sum("_new").over(along)).groupBy(*keys, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


def first_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key in ``order``, with their ``rank`` from 1; rows that ``order`` doesn't tell apart go in any order.

    The planner keeps the first ``k`` of each key in every task before anything is shuffled, so a key with very many rows sends
    ``k`` rows a task.
    """
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)
