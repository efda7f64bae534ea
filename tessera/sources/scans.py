"""Scans of a live catalog: the standard information schema, over JDBC or as DataFrames, into catalog rows.

The joins and filters are Spark's; each scan is one query for the whole catalog instead of one for each table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.catalog import Catalog

VIEWS = ("tables", "columns", "views", "table_constraints", "key_column_usage", "referential_constraints", "check_constraints", "schemata", "sequences")
#: Schemas and tables of the server itself.
SYSTEM_SCHEMAS = ("information_schema", "pg_catalog", "pg_toast")
SYSTEM_TABLES = ("schema_migrations",)


def read_information_schema(spark: SparkSession, url: str, **properties: str) -> dict[str, DataFrame]:
    """The views of the information schema of a database."""
    return {v: spark.read.jdbc(url, f"information_schema.{v}", properties=properties) for v in VIEWS}


def _users(df: DataFrame, column: str, exclude: Sequence[str]) -> DataFrame:
    schema = F.col(column)
    return df.filter(~schema.isin(*SYSTEM_SCHEMAS, *exclude) & ~schema.like(r"pg\_%") & ~schema.like(r"\_timescaledb%"))


def scan_tables(found: Mapping[str, DataFrame], partitions: DataFrame | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """(schema, name) of base tables that aren't the server's, nor partitions (schema, name) of another."""
    tables = _users(found["tables"], "table_schema", exclude).filter(F.col("table_type") == "BASE TABLE").select(F.col("table_schema").alias("schema"), F.col("table_name").alias("name"))
    tables = tables.filter(~F.col("name").isin(*SYSTEM_TABLES))
    return tables if partitions is None else tables.join(partitions, ["schema", "name"], "left_anti")


def scan_columns(found: Mapping[str, DataFrame], tables: DataFrame) -> DataFrame:
    c = found["columns"].select(
        F.col("table_schema").alias("schema"), F.col("table_name").alias("table"), F.col("column_name").alias("name"), F.col("ordinal_position").cast("int").alias("position"), F.lower("data_type").alias("base"),
        (F.upper("is_nullable").isin("YES", "TRUE")).alias("nullable"), F.col("column_default").alias("default"), F.col("character_maximum_length").cast("int").alias("n"), F.col("numeric_precision").cast("int").alias("p"), F.col("numeric_scale").cast("int").alias("s"),
    )
    sized = F.when(F.col("n").isNotNull() & F.col("base").rlike("char"), F.format_string("%s(%d)", "base", "n")).when(F.col("base").isin("numeric", "decimal") & F.col("p").isNotNull(), F.format_string("%s(%d,%d)", "base", "p", F.coalesce("s", F.lit(0)))).otherwise(F.col("base"))
    own = tables.select("schema", F.col("name").alias("table"))
    return c.join(own, ["schema", "table"], "left_semi").select("schema", "table", "name", "position", sized.alias("type"), "nullable", "default")


def scan_constraints(found: Mapping[str, DataFrame], tables: DataFrame) -> DataFrame:
    """Constraints with their columns in order, the key that a foreign one refers to, and its actions."""
    key = ["constraint_schema", "constraint_name"]
    usage = found["key_column_usage"].groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col("ordinal_position").cast("int").alias("i"), "column_name"))).alias("u"), F.min("table_schema").alias("us"), F.min("table_name").alias("ut"))
    usage = usage.select(*key, F.col("u.column_name").alias("columns"), "us", "ut")
    target = usage.select(F.col("constraint_schema").alias("unique_constraint_schema"), F.col("constraint_name").alias("unique_constraint_name"), F.col("columns").alias("ref_columns"), F.concat_ws(".", "us", "ut").alias("ref_table"))
    refers = found["referential_constraints"].select(*key, "unique_constraint_schema", "unique_constraint_name", F.col("delete_rule").alias("on_delete"), F.col("update_rule").alias("on_update"))
    refers = refers.join(target, ["unique_constraint_schema", "unique_constraint_name"], "left").drop("unique_constraint_schema", "unique_constraint_name")
    own = tables.select(F.col("schema").alias("table_schema"), F.col("name").alias("table_name"))
    named = found["table_constraints"].join(own, ["table_schema", "table_name"], "left_semi").filter(~F.col("constraint_name").rlike("_not_null$"))
    joined = reduce(lambda a, b: a.join(b, key, "left"), (usage.drop("us", "ut"), refers, found["check_constraints"].select(*key, F.col("check_clause").alias("expression"))), named)
    yes = lambda c: F.upper(F.coalesce(F.col(c).cast("string"), F.lit("NO"))).isin("YES", "TRUE")
    return joined.select(
        F.col("table_schema").alias("schema"), F.col("table_name").alias("table"), F.col("constraint_name").alias("name"), F.col("constraint_type").alias("kind"), F.coalesce("columns", F.array().cast("array<string>")).alias("columns"), "ref_table", "ref_columns", "on_delete", "on_update", "expression",
        yes("is_deferrable").alias("deferrable"), yes("initially_deferred").alias("initially_deferred"),
    )


def scan_views(found: Mapping[str, DataFrame], aggregates: DataFrame | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """(schema, name, definition) of views that don't belong to a continuous aggregate (schema, name)."""
    views = _users(found["views"], "table_schema", exclude).select(F.col("table_schema").alias("schema"), F.col("table_name").alias("name"), F.col("view_definition").alias("definition"))
    return views if aggregates is None else views.join(aggregates, ["schema", "name"], "left_anti")


def extract(found: Mapping[str, DataFrame], exclude: Sequence[str] = ()) -> Catalog:
    """The catalog of a database. A catalog is small; its rows are collected once the scans are done."""
    tables = scan_tables(found, exclude=exclude)
    scans = {"schemas": _users(found["schemata"], "schema_name", exclude).select(F.col("schema_name").alias("name")).distinct(), "tables": tables, "columns": scan_columns(found, tables), "constraints": scan_constraints(found, tables), "views": scan_views(found, exclude=exclude)}
    return Catalog({kind: [r.asDict() for r in df.collect()] for kind, df in scans.items()})
