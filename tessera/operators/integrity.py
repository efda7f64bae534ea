"""Declared constraints as data-quality queries. Each returns what violates it; an empty result means it holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str], nulls_distinct: bool = True, where: Column | None = None) -> DataFrame:
    """(keys, n): keys that more than one row has. Rows with a null key don't count, unless nulls are not distinct.

    ``where`` restricts it as a partial unique index does. Counts are formed before the shuffle, so a hot key is no burden.
    """
    rows = df if where is None else df.filter(where)
    if nulls_distinct:
        rows = rows.dropna(subset=list(keys))
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def null_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, n): how many nulls each column that must have none has; all columns in one pass."""
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n")) for c in columns))).alias("r")).select("r.*")


def orphans(child: DataFrame, parent: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """Child rows whose foreign key, if no part of it is null, no parent row has."""
    keys = parent.select(*(F.col(p).alias(f"_{p}") for _, p in on)).distinct() if len(on) > 1 else parent.select(F.col(on[0][1]).alias(f"_{on[0][1]}"))
    cond = [F.col(c) == F.col(f"_{p}") for c, p in on]
    return child.dropna(subset=[c for c, _ in on]).join(keys, cond, "left_anti")


def check_violations(df: DataFrame, check: Column) -> DataFrame:
    """Rows for which the check is false; null is no violation."""
    return df.filter(~check)


def enum_violations(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*values))


def domain_violations(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose value doesn't match a domain's regular expression."""
    return df.filter(~F.col(column).rlike(pattern))


def overlapping(df: DataFrame, keys: Sequence[str], low: str, high: str, row_id: str) -> DataFrame:
    """Rows whose half-open range overlaps that of another row with equal keys, as an exclusion constraint forbids.

    In the order of their beginnings a range overlaps an earlier one if it begins before the furthest end so far, and a
    later one if the next begins before its end. That is one sort, not a comparison of all pairs; empty ranges overlap nothing.
    """
    ranges = df.filter(F.col(low) < F.col(high))
    order = W.partitionBy(*keys).orderBy(low, row_id)
    furthest = F.max(high).over(order.rowsBetween(W.unboundedPreceding, -1))
    following = F.lead(low).over(order)
    marked = ranges.withColumns({"_far": furthest, "_next": following})
    return marked.filter((F.col(low) < F.col("_far")) | (F.col("_next") < F.col(high))).drop("_far", "_next")
