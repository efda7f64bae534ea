"""Sketches that are stored and merged: distinct counts by hour that add up to days without the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.time import time_bucket

#: Registers of a sketch, as a power of two: a relative standard error of 1.04 / sqrt(2 ** 12), 1.6 %, in 4 KB at most.
PRECISION = 12


def distinct_sketches(df: DataFrame, keys: Sequence[str], ts: str, width: str, counted: Mapping[str, Column], precision: int = PRECISION) -> DataFrame:
    """(bucket, keys, a sketch for each of ``counted``): what a later count of distinct values needs of these rows. Rows without a
    time are left out, nulls aren't counted."""
    rows = df.filter(F.col(ts).isNotNull()).groupBy(time_bucket(width, ts).alias("bucket"), *keys)
    return rows.agg(*(F.hll_sketch_agg(c, F.lit(precision)).alias(n) for n, c in counted.items()))


def merged_sketches(sketches: DataFrame, keys: Sequence[str], width: str, names: Sequence[str]) -> DataFrame:
    """The same for wider buckets, or fewer keys, out of stored sketches: a value in several of them counts once."""
    return sketches.groupBy(time_bucket(width, "bucket").alias("bucket"), *keys).agg(*(F.hll_union_agg(n).alias(n) for n in names))


def estimates(sketches: DataFrame, names: Sequence[str]) -> DataFrame:
    """The sketches as numbers."""
    return sketches.withColumns({n: F.hll_sketch_estimate(n) for n in names})


def bound(precision: int = PRECISION, deviations: float = 4) -> float:
    """The relative error that an estimate stays within, at so many standard deviations."""
    return deviations * 1.04 / 2 ** (precision / 2)
