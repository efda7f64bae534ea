"""The catalog: one table for each kind of declared entity, as rows and as DataFrames."""

from __future__ import annotations

import json
from collections import defaultdict
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1.0"
SCHEMAS: dict[str, str] = {
    "schemas": "name string",
    "extensions": "name string, schema string, version string, comment string",
    "types": "schema string, name string, kind string, definition string, labels array<string>, comment string",
    "sequences": "schema string, name string, start bigint, min_value bigint, max_value bigint, increment bigint, cache bigint, cycle boolean, owned_by string",
    "tables": "schema string, name string, comment string, partition_type string, partition_columns array<string>",
    "partitions": "schema string, name string, parent string, bounds string",
    "columns": "schema string, table string, name string, position int, type string, nullable boolean, default string, comment string, identity string, generated string",
    "constraints": "schema string, table string, name string, kind string, columns array<string>, ref_table string, ref_columns array<string>, on_delete string, on_update string, expression string, deferrable boolean, initially_deferred boolean",
    "indexes": "schema string, table string, name string, method string, columns array<string>, include array<string>, is_unique boolean, nulls_not_distinct boolean, predicate string, params map<string,string>",
    "views": "schema string, name string, definition string, check_option string, comment string",
    "materialized_views": "schema string, name string, definition string, with_data boolean, comment string",
    "functions": "schema string, name string, args string, arg_types string, returns string, language string, volatility string, strict boolean, security_definer boolean, body string, comment string",
    "triggers": "schema string, table string, name string, timing string, events array<string>, update_columns array<string>, per_row boolean, condition string, function string",
    "hypertables": "schema string, table string, time_column string, chunk_interval string, space_column string, space_partitions int",
    "compression": "schema string, table string, segment_by array<string>, order_by array<string>, compress_after string",
    "retention": "schema string, table string, drop_after string, schedule string",
    "aggregates": "schema string, name string, source string, definition string, with_data boolean, comment string",
    "refreshes": "schema string, name string, start_offset string, end_offset string, schedule string",
    "warnings": "line int, message string",
}
#: What identifies an entity of each kind.
KEYS: dict[str, tuple[str, ...]] = {
    "schemas": ("name",), "extensions": ("name",), "types": ("schema", "name"), "sequences": ("schema", "name"), "tables": ("schema", "name"), "partitions": ("schema", "name"), "columns": ("schema", "table", "name"),
    "constraints": ("schema", "table", "name"), "indexes": ("schema", "name"), "views": ("schema", "name"), "materialized_views": ("schema", "name"), "functions": ("schema", "name", "arg_types"),
    "triggers": ("schema", "table", "name"), "hypertables": ("schema", "table"), "compression": ("schema", "table"), "retention": ("schema", "table"), "aggregates": ("schema", "name"), "refreshes": ("schema", "name"), "warnings": ("line", "message"),
}


class Catalog:
    """Rows of each kind. A later row of the same key takes the place of an earlier one."""

    def __init__(self, rows: dict[str, list[dict[str, Any]]] | None = None) -> None:
        self.rows: dict[str, list[dict[str, Any]]] = defaultdict(list)
        for kind, several in (rows or {}).items():
            for row in several:
                self.put(kind, **row)

    def put(self, entity: str, /, **row: Any) -> dict[str, Any]:
        whole = dict.fromkeys(fields(entity)) | row
        key = tuple(whole[k] for k in KEYS[entity])
        self.rows[entity] = [r for r in self.rows[entity] if tuple(r[k] for k in KEYS[entity]) != key]
        self.rows[entity].append(whole)
        return whole

    def find(self, entity: str, /, **key: Any) -> dict[str, Any] | None:
        return next((r for r in self.rows[entity] if all(r[k] == v for k, v in key.items())), None)

    def sorted_rows(self, kind: str) -> list[dict[str, Any]]:
        keys = ("schema", "table", "position") if kind == "columns" else KEYS[kind]
        return sorted(self.rows[kind], key=lambda r: tuple((r[k] is None, r[k]) for k in keys))

    def frame(self, spark: SparkSession, kind: str) -> DataFrame:
        names = fields(kind)
        return spark.createDataFrame([tuple(r[n] for n in names) for r in self.sorted_rows(kind)], SCHEMAS[kind])

    def frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {kind: self.frame(spark, kind) for kind in SCHEMAS}

    def counts(self) -> dict[str, int]:
        """How many entities of each kind there are, kinds without any too."""
        return {kind: len(self.rows[kind]) for kind in SCHEMAS if kind != "warnings"}

    def to_json(self) -> str:
        return json.dumps({"version": VERSION} | {kind: self.sorted_rows(kind) for kind in SCHEMAS if self.rows[kind]}, indent=2, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Catalog:
        found = json.loads(text)
        if found.pop("version", VERSION) != VERSION:
            raise ValueError("the catalog is of another version")
        if unknown := found.keys() - SCHEMAS.keys():
            raise ValueError(f"unknown kinds of entities: {sorted(unknown)}")
        return cls(found)


def fields(kind: str) -> list[str]:
    """Names of a kind's columns."""
    depth, out = 0, []
    for part in SCHEMAS[kind].split(","):
        if depth == 0:
            out.append(part.strip().split(" ")[0])
        depth += part.count("<") - part.count(">")
    return out


def read_json(spark: SparkSession, path: str) -> Catalog:
    """A stored catalog from wherever Spark reads."""
    return Catalog.from_json("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def write_json(spark: SparkSession, catalog: Catalog, path: str) -> None:
    spark.createDataFrame([(catalog.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_directory(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(path, text) of all ``.sql`` files below a folder, by path. These are a schema's few sources, not data."""
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.sql").text(path, wholetext=True)
    return sorted((r[0], r[1]) for r in found.select(F.input_file_name(), "value").collect())


#: Declared names of Spark's types.
_TYPES = {"tinyint": "smallint", "smallint": "smallint", "int": "integer", "bigint": "bigint", "float": "real", "double": "double precision", "boolean": "boolean", "string": "text", "date": "date", "timestamp": "timestamp with time zone", "timestamp_ntz": "timestamp without time zone", "binary": "bytea"}


def declared_type(spark_type: str) -> str:
    if spark_type.startswith("array<"):
        return declared_type(spark_type[6:-1]) + "[]"
    if spark_type.startswith("decimal"):
        return spark_type.replace("decimal", "numeric")
    return _TYPES.get(spark_type, spark_type)


#: Folders of a schema's sources, in the order in which they are read.
FOLDERS = ("schemas", "extensions", "types", "sequences", "tables", "views", "materialized_views", "functions", "triggers", "hypertables", "policies")


def read_folders(spark: SparkSession, path: str, folders: tuple[str, ...] = FOLDERS) -> list[tuple[str, str]]:
    """(path, text) of the ``.sql`` files in fixed folders below one, folder by folder; other folders are left out, those
    that aren't there are empty."""
    below = len(path.rstrip("/").split("/")) if "://" not in path else None
    rank = {f: i for i, f in enumerate(folders)}
    out = []
    for where, text in read_directory(spark, path):
        steps = where.removeprefix("file://").split("/") if below is not None else where.removeprefix(path.rstrip("/") + "/").split("/")
        folder = steps[below or 0] if len(steps) > (below or 0) + 1 else ""
        if folder in rank:
            out.append((rank[folder], where, text))
    return [(where, text) for _, where, text in sorted(out)]


def extract_tables(tables: dict[str, DataFrame], schema: str = "public") -> Catalog:
    """The catalog of DataFrames: what tables there are and what their columns are, without reading a row."""
    catalog = Catalog()
    for name, df in sorted(tables.items()):
        catalog.put("tables", schema=schema, name=name)
        for i, f in enumerate(df.schema.fields, 1):
            catalog.put("columns", schema=schema, table=name, name=f.name, position=i, type=declared_type(f.dataType.simpleString()), nullable=f.nullable, comment=f.metadata.get("comment"))
    return catalog
