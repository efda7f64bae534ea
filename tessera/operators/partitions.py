"""Declared partitions: which partition rows belong to, and whether a partition set is whole."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def hash_partition(key: Column, modulus: int) -> Column:
    """Remainder of an integer key; other types are hashed first."""
    return F.pmod(key, F.lit(modulus)).cast("int")


def range_partition(column: Column, bounds: Mapping[str, tuple[Any, Any]], default: str | None = None) -> Column:
    """Name of the partition with ``low <= value < high``; None as a bound means that the range is open there."""
    out: Column | None = None
    for name, (low, high) in bounds.items():
        inside = F.lit(True)
        if low is not None:
            inside = inside & (column >= F.lit(low))
        if high is not None:
            inside = inside & (column < F.lit(high))
        out = F.when(inside & column.isNotNull(), name) if out is None else out.when(inside & column.isNotNull(), name)
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def list_partition(column: Column, lists: Mapping[str, Sequence[Any]], default: str | None = None) -> Column:
    out: Column | None = None
    for name, values in lists.items():
        out = F.when(column.isin(*values), name) if out is None else out.when(column.isin(*values), name)
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def missing_remainders(spark: SparkSession, declared: DataFrame) -> DataFrame:
    """(parent, modulus, remainder) that a hash-partitioned parent's declared (parent, modulus, remainder) lack."""
    wanted = declared.select("parent", "modulus").distinct().select("parent", "modulus", F.explode(F.sequence(F.lit(0), F.col("modulus") - 1)).alias("remainder"))
    return wanted.join(declared, ["parent", "modulus", "remainder"], "left_anti")


def partition_ddl(spark: SparkSession, parent: str, modulus: int, schema: str = "public") -> DataFrame:
    """(remainder, name, sql): the statements that create all hash partitions of ``parent``."""
    if modulus < 1:
        raise ValueError("the modulus must be positive")
    name = F.format_string(f"{parent}_%0{max(2, len(str(modulus - 1)))}d", F.col("remainder"))
    rows = spark.range(modulus).select(F.col("id").cast("int").alias("remainder"))
    sql = F.concat(F.lit(f"CREATE TABLE {schema}."), F.col("name"), F.lit(f" PARTITION OF {schema}.{parent} FOR VALUES WITH (MODULUS {modulus}, REMAINDER "), F.col("remainder").cast("string"), F.lit(");"))
    return rows.withColumn("name", name).withColumn("sql", sql)
