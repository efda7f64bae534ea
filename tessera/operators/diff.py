"""Differences between a current and a desired catalog, as one keyed full outer comparison for each kind of entity.

A kind's rules are SQL conditions over ``c`` (current) and ``d`` (desired). What only one side has is added or dropped;
what both have gives one change for each rule that holds. Every change has a type, a severity and the two values.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import normalize as N
from tessera.functions.canonical import canonical, sources
from tessera.sources.catalog import KEYS, Catalog

SAFE, RISKY, BREAKING, MIGRATION = "SAFE", "POTENTIALLY_BREAKING", "BREAKING", "DATA_MIGRATION_REQUIRED"
CHANGES = "change_type string, severity string, object_type string, object_name string, table_name string, old_value string, new_value string"


@dataclass(frozen=True)
class Rule:
    """``when`` may use ``{norm[...]}``-style functions through ``sql``: a callable of the dialect."""

    change: str
    when: Any
    severity: Any = f"'{SAFE}'"
    old: Any = "NULL"
    new: Any = "NULL"


@dataclass(frozen=True)
class Kind:
    entity: str
    object_type: str
    add: tuple[str, str] | None = None
    drop: tuple[str, str] | None = None
    rules: tuple[Rule, ...] = ()
    #: Compared only inside of tables that both sides have.
    inside_tables: bool = False
    #: Conditions under which an added or dropped one gives no change.
    add_if: str = "TRUE"
    drop_if: str = "TRUE"
    #: Normal forms that several rules use: name and SQL of the dialect, over a plain row.
    derived: tuple[tuple[str, Any], ...] = ()


def _text(x: Any, dialect: str) -> str:
    return x(dialect) if callable(x) else x


def _differs(column: str) -> str:
    return f"c.{column} IS DISTINCT FROM d.{column}"


def _norm_differs(f, column: str):
    return lambda dialect: f"{f(f'c.{column}', dialect)} IS DISTINCT FROM {f(f'd.{column}', dialect)}"


def _severity(when: str, then: str, otherwise: str) -> str:
    return f"CASE WHEN {when} THEN '{then}' ELSE '{otherwise}' END"


def _partitioning(side: str) -> str:
    return f"{side}.partition_type || ' (' || coalesce({side}.partition_columns, '') || ')'"


def _listed(value: Any) -> Any:
    """Lists and maps as text; what separates entries is marked where it is part of one."""
    mark = lambda x: re.sub(r"([\\,=])", r"\\\1", str(x))
    if isinstance(value, dict):
        return ",".join(f"{mark(a)}={mark(b)}" for a, b in sorted(value.items()))
    return ",".join(mark(x) if isinstance(x, str) and "," in x else str(x) for x in value) if isinstance(value, list) else value


def _comment_rule(change: str, severity: str = f"'{SAFE}'") -> Rule:
    return Rule(change, _norm_differs(N.comment_sql, "comment"), severity, "c.comment", "d.comment")


def _type_severity(dialect: str) -> str:
    return _severity(N.widens_sql("c.norm_type", "d.norm_type", dialect), SAFE, MIGRATION)


_CONSTRAINT = " OR ".join(
    [_differs(x) for x in ("kind", "columns", "ref_table", "ref_columns", "deferrable", "initially_deferred", "canonical_expression")] + [f"{N.action_sql(f'c.{x}')} IS DISTINCT FROM {N.action_sql(f'd.{x}')}" for x in ("on_delete", "on_update")]
)
_INDEX = " OR ".join(_differs(x) for x in ("method", "canonical_columns", "sorted_include", "is_unique", "nulls_not_distinct", "canonical_predicate", "params"))
_FUNCTION = lambda dialect: " OR ".join([_differs(x) for x in ("returns", "language", "volatility", "strict", "security_definer")] + [f"{N.body_sql('c.body', dialect)} IS DISTINCT FROM {N.body_sql('d.body', dialect)}"])
_TRIGGER = " OR ".join(_differs(x) for x in ("timing", "events", "update_columns", "per_row", "canonical_condition", "function"))
_OFFSETS = lambda dialect: " OR ".join(f"{N.interval_sql(f'c.{x}', dialect)} IS DISTINCT FROM {N.interval_sql(f'd.{x}', dialect)}" for x in ("start_offset", "end_offset", "schedule"))

KINDS: dict[str, Kind] = {
    k.entity: k
    for k in (
        Kind("schemas", "schema", ("ADD_SCHEMA", f"'{SAFE}'"), ("DROP_SCHEMA", f"'{BREAKING}'"), drop_if="c.name <> 'public'"),
        Kind("extensions", "extension", ("ADD_EXTENSION", f"'{SAFE}'"), ("DROP_EXTENSION", f"'{BREAKING}'"), (Rule("MODIFY_EXTENSION", f"{_differs('schema')} OR (d.version IS NOT NULL AND {_differs('version')})", f"'{RISKY}'", "c.version", "d.version"), _comment_rule("MODIFY_EXTENSION_COMMENT"))),
        Kind(
            "types", "type", ("ADD_CUSTOM_TYPE", f"'{SAFE}'"), ("DROP_CUSTOM_TYPE", f"'{BREAKING}'"),
            (Rule("MODIFY_CUSTOM_TYPE", f"c.kind = 'enum' AND {_differs('labels')}", _severity("d.labels LIKE c.labels || ',%'", SAFE, BREAKING), "c.labels", "d.labels"),
             Rule("MODIFY_CUSTOM_TYPE", f"c.kind <> 'enum' AND {_differs('definition')}", f"'{BREAKING}'", "c.definition", "d.definition"),
             _comment_rule("MODIFY_CUSTOM_TYPE_COMMENT")),
        ),
        Kind("sequences", "sequence", ("ADD_SEQUENCE", f"'{SAFE}'"), ("DROP_SEQUENCE", _severity("c.owned_by IS NOT NULL", RISKY, BREAKING)), (Rule("MODIFY_SEQUENCE", " OR ".join(_differs(x) for x in ("start", "increment", "min_value", "max_value", "cache", "cycle"))),)),
        Kind("tables", "table", ("ADD_TABLE", f"'{SAFE}'"), ("DROP_TABLE", f"'{BREAKING}'"), (_comment_rule("MODIFY_TABLE_COMMENT", _severity("d.comment IS NULL", RISKY, SAFE)),
             Rule("MODIFY_TABLE_PARTITIONING", f"{_differs('partition_type')} OR {_differs('partition_columns')}", f"'{BREAKING}'", _partitioning("c"), _partitioning("d")))),
        Kind("partitions", "partition", ("ADD_PARTITION", f"'{SAFE}'"), ("DROP_PARTITION", f"'{BREAKING}'"), (Rule("MODIFY_PARTITION", _norm_differs(N.body_sql, "bounds"), f"'{BREAKING}'", "c.bounds", "d.bounds"),)),
        Kind(
            "columns", "column", ("ADD_COLUMN", _severity('NOT d.nullable AND d."default" IS NULL AND d.identity IS NULL AND d.generated IS NULL', MIGRATION, SAFE)), ("DROP_COLUMN", _severity("NOT c.nullable", BREAKING, RISKY)),
            (Rule("MODIFY_COLUMN_TYPE", _differs("norm_type"), _type_severity, "c.type", "d.type"),
             Rule("MODIFY_COLUMN_NULLABILITY", _differs("nullable"), _severity("d.nullable", SAFE, MIGRATION), "CASE WHEN c.nullable THEN 'NULL' ELSE 'NOT NULL' END", "CASE WHEN d.nullable THEN 'NULL' ELSE 'NOT NULL' END"),
             Rule("MODIFY_COLUMN_DEFAULT", _norm_differs(N.default_sql, '"default"'), f"'{SAFE}'", 'c."default"', 'd."default"'),
             Rule("MODIFY_COLUMN_IDENTITY", _differs("identity"), f"'{RISKY}'", "c.identity", "d.identity"),
             Rule("MODIFY_COLUMN_GENERATED", _differs("canonical_generated"), _severity("d.generated IS NULL", RISKY, MIGRATION), "c.generated", "d.generated"),
             _comment_rule("MODIFY_COLUMN_COMMENT")),
            inside_tables=True, derived=(("norm_type", lambda q: N.type_sql("type", q)),),
        ),
        Kind("constraints", "constraint", ("ADD_CONSTRAINT", _severity("d.kind = 'FOREIGN KEY' OR (d.kind = 'CHECK' AND lower(d.expression) LIKE '%not null%')", MIGRATION, SAFE)), ("DROP_CONSTRAINT", _severity("c.kind IN ('PRIMARY KEY', 'UNIQUE')", BREAKING, RISKY)), (Rule("MODIFY_CONSTRAINT", _CONSTRAINT, f"'{RISKY}'", "c.kind", "d.kind"),), inside_tables=True),
        Kind("indexes", "index", ("ADD_INDEX", f"'{SAFE}'"), ("DROP_INDEX", _severity("c.is_unique", BREAKING, RISKY)), (Rule("MODIFY_INDEX", _INDEX, _severity("d.is_unique", BREAKING, RISKY), "c.columns", "d.columns"),), add_if="NOT d.of_constraint", drop_if="NOT c.of_constraint"),
        Kind("views", "view", ("ADD_VIEW", f"'{SAFE}'"), ("DROP_VIEW", f"'{BREAKING}'"), (Rule("MODIFY_VIEW", lambda q: f"{_differs('canonical_definition')} OR {N.check_option_sql('c.check_option', q)} IS DISTINCT FROM {N.check_option_sql('d.check_option', q)}", f"'{RISKY}'", "c.definition", "d.definition"), _comment_rule("MODIFY_VIEW"))),
        Kind("materialized_views", "materialized view", ("ADD_MATERIALIZED_VIEW", f"'{SAFE}'"), ("DROP_MATERIALIZED_VIEW", f"'{BREAKING}'"), (Rule("MODIFY_MATERIALIZED_VIEW", _differs("canonical_definition"), f"'{RISKY}'", "c.definition", "d.definition"), _comment_rule("MODIFY_MATERIALIZED_VIEW"))),
        Kind("functions", "function", ("ADD_FUNCTION", f"'{SAFE}'"), ("DROP_FUNCTION", f"'{BREAKING}'"), (Rule("MODIFY_FUNCTION", _FUNCTION, _severity("c.used_by_trigger", BREAKING, RISKY)), _comment_rule("MODIFY_FUNCTION"))),
        Kind("triggers", "trigger", ("ADD_TRIGGER", f"'{SAFE}'"), ("DROP_TRIGGER", f"'{BREAKING}'"), (Rule("MODIFY_TRIGGER", _TRIGGER, f"'{BREAKING}'", "c.function", "d.function"),), drop_if="NOT c.of_partition"),
        Kind("hypertables", "hypertable", ("ADD_HYPERTABLE", f"'{SAFE}'"), ("DROP_HYPERTABLE", f"'{BREAKING}'"), (Rule("MODIFY_HYPERTABLE", lambda q: f"{_differs('time_column')} OR {_differs('space_column')} OR {_differs('space_partitions')} OR {N.interval_sql('c.chunk_interval', q)} IS DISTINCT FROM {N.interval_sql('d.chunk_interval', q)}", f"'{RISKY}'", "c.chunk_interval", "d.chunk_interval"),)),
        Kind("compression", "compression policy", ("ADD_COMPRESSION_POLICY", f"'{SAFE}'"), ("DROP_COMPRESSION_POLICY", f"'{RISKY}'"), (Rule("MODIFY_COMPRESSION_POLICY", lambda q: f"{_differs('sorted_segment_by')} OR {_differs('order_by')} OR {N.interval_sql('c.compress_after', q)} IS DISTINCT FROM {N.interval_sql('d.compress_after', q)}", f"'{RISKY}'", "c.order_by", "d.order_by"),)),
        Kind("retention", "retention policy", ("ADD_RETENTION_POLICY", f"'{BREAKING}'"), ("DROP_RETENTION_POLICY", f"'{SAFE}'"), (Rule("MODIFY_RETENTION_POLICY", _norm_differs(N.interval_sql, "drop_after"), lambda q: _severity(f"{N.seconds_sql('d.drop_after', q)} < {N.seconds_sql('c.drop_after', q)}", BREAKING, RISKY), "c.drop_after", "d.drop_after"),)),
        Kind("aggregates", "continuous aggregate", ("ADD_CONTINUOUS_AGGREGATE", f"'{SAFE}'"), ("DROP_CONTINUOUS_AGGREGATE", f"'{BREAKING}'"), (Rule("MODIFY_CONTINUOUS_AGGREGATE", f"{_differs('canonical_definition')} OR {_differs('source')}", f"'{BREAKING}'", "c.definition", "d.definition"),)),
        Kind("refreshes", "refresh policy", ("ADD_REFRESH_POLICY", f"'{SAFE}'"), ("DROP_REFRESH_POLICY", f"'{RISKY}'"), (Rule("MODIFY_REFRESH_POLICY", _OFFSETS, f"'{RISKY}'", "c.start_offset", "d.start_offset"),)),
    )
}

#: Columns of the flat rows that rules use beyond the catalog's own.
_EXTRA: dict[str, tuple[str, ...]] = {
    "columns": ("canonical_generated string",),
    "constraints": ("canonical_expression string",), "indexes": ("canonical_columns string", "sorted_include string", "canonical_predicate string", "of_constraint boolean"), "views": ("canonical_definition string",),
    "materialized_views": ("canonical_definition string",), "functions": ("used_by_trigger boolean",), "triggers": ("canonical_condition string", "of_partition boolean"), "compression": ("sorted_segment_by string",), "aggregates": ("canonical_definition string",),
}


def flat_schema(entity: str) -> list[tuple[str, str]]:
    """(name, type) of flat rows: lists and maps are text."""
    from tessera.sources.catalog import SCHEMAS, fields

    types = [t for t in SCHEMAS[entity].replace("map<string,string>", "text").replace("array<string>", "text").split(",")]
    out = [(n, "string" if t.strip().split(" ")[1] == "text" else t.strip().split(" ")[1]) for n, t in zip(fields(entity), types)]
    return out + [tuple(x.split(" ")) for x in _EXTRA.get(entity, ())]


def flat_rows(catalog: Catalog, entity: str) -> list[tuple]:
    """The rows of a kind with canonical forms of what is SQL text, and what other kinds say about them."""
    out = []
    for row in catalog.sorted_rows(entity):
        r: dict[str, Any] = {k: _listed(v) for k, v in row.items()}
        text = lambda x: canonical(x) if x else None
        if entity == "columns":
            r["canonical_generated"] = text(row["generated"])
        elif entity == "constraints":
            r["canonical_expression"] = text(row["expression"])
        elif entity == "indexes":
            r |= {"canonical_columns": ",".join(canonical(c) for c in row["columns"]), "sorted_include": ",".join(sorted(x.lower() for x in row["include"] or [])), "canonical_predicate": text(row["predicate"])}
            r["of_constraint"] = any(c["name"] == row["name"] and (c["schema"], c["table"]) == (row["schema"], row["table"]) for c in catalog.rows["constraints"])
        elif "definition" in row and entity != "types":
            r["canonical_definition"] = text(row["definition"])
        elif entity == "functions":
            r["used_by_trigger"] = any(t["function"] == f"{row['schema']}.{row['name']}" for t in catalog.rows["triggers"])
        elif entity == "triggers":
            parents = {p["parent"] for p in catalog.rows["partitions"] if (p["schema"], p["name"]) == (row["schema"], row["table"])}
            r |= {"canonical_condition": text(row["condition"]), "of_partition": any(f"{t['schema']}.{t['table']}" in parents and t["name"] == row["name"] for t in catalog.rows["triggers"])}
        elif entity == "compression":
            r["sorted_segment_by"] = ",".join(sorted(row["segment_by"] or []))
        out.append(tuple(r[n] for n, _ in flat_schema(entity)))
    return out


def flat_frame(spark: SparkSession, catalog: Catalog, entity: str) -> DataFrame:
    """The flat rows in one partition: they come from the driver, so they are few, and need no shuffle to be compared."""
    schema = flat_schema(entity)
    rows = flat_rows(catalog, entity)
    table = pa.table([pa.array([r[i] for r in rows], _ARROW[t]) for i, (_, t) in enumerate(schema)], [n for n, _ in schema])
    return spark.createDataFrame(table).coalesce(1)


_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}


def _names(kind: Kind, side: str) -> tuple[str, str]:
    """SQL of an object's qualified name and of its table, if it has one."""
    columns = KEYS[kind.entity]
    parts = [f"{side}.{x}" for x in columns if x != "arg_types"]
    name = " || '.' || ".join(parts)
    if "arg_types" in columns:
        name += f" || '(' || {side}.arg_types || ')'"
    own = [n for n, _ in flat_schema(kind.entity)]
    table = f"{side}.schema || '.' || {side}.table" if "table" in own else f"{side}.parent" if "parent" in own else f"{side}.schema || '.' || {side}.name" if kind.entity == "tables" else "NULL"
    return name, table


def _branches(kind: Kind, dialect: str) -> list[tuple[str, ...]]:
    """(condition, change type, severity, name, table, old, new) of everything that may come out of a joined row."""
    (cn, ct), (dn, dt) = _names(kind, "c"), _names(kind, "d")
    out = []
    if kind.add:
        out.append((f"c.here IS NULL AND {kind.add_if}", f"'{kind.add[0]}'", kind.add[1], dn, dt, "NULL", "NULL"))
    if kind.drop:
        out.append((f"d.here IS NULL AND {kind.drop_if}", f"'{kind.drop[0]}'", kind.drop[1], cn, ct, "NULL", "NULL"))
    for r in kind.rules:
        out.append((f"c.here AND d.here AND ({_text(r.when, dialect)})", f"'{r.change}'", _text(r.severity, dialect), dn, dt, _text(r.old, dialect), _text(r.new, dialect)))
    return out


def keyed_diff(current: DataFrame, desired: DataFrame, kind: Kind) -> DataFrame:
    """Changes between the flat rows of one kind. Keys are matched null-safely; each side has a key once."""
    more = {"here": F.lit(True)} | {n: F.expr(_text(sql, "spark")) for n, sql in kind.derived}
    c, d = current.withColumns(more).alias("c"), desired.withColumns(more).alias("d")
    on = reduce(lambda a, b: a & b, (F.col(f"c.{k}").eqNullSafe(F.col(f"d.{k}")) for k in KEYS[kind.entity]))
    rows = []
    for when, change, severity, name, table, old, new in _branches(kind, "spark"):
        spark_text = lambda s: s.replace('"default"', "`default`")
        fields = zip(("change_type", "severity", "object_type", "object_name", "table_name", "old_value", "new_value"), (change, severity, f"'{kind.object_type}'", name, table, old, new))
        row = "named_struct(" + ", ".join(f"'{n}', cast({spark_text(v)} AS string)" for n, v in fields) + ")"
        rows.append(F.expr(f"CASE WHEN {spark_text(when)} THEN {row} END"))
    return c.join(d, on, "full_outer").select(F.explode(F.array_compact(F.array(*rows))).alias("r")).select("r.*")


def diff_kind(spark: SparkSession, current: Catalog, desired: Catalog, entity: str) -> DataFrame:
    kind = KINDS[entity]
    c, d = flat_frame(spark, current, entity), flat_frame(spark, desired, entity)
    if kind.inside_tables:
        both = flat_frame(spark, current, "tables").join(flat_frame(spark, desired, "tables"), ["schema", "name"]).select(F.col("schema"), F.col("name").alias("table"))
        c, d = c.join(both, ["schema", "table"], "left_semi"), d.join(both, ["schema", "table"], "left_semi")
    if entity == "indexes":  # an index goes with its table
        stays = flat_frame(spark, desired, "tables").select("schema", F.col("name").alias("table"))
        for other in ("materialized_views", "aggregates"):
            stays = stays.union(flat_frame(spark, desired, other).select("schema", F.col("name").alias("table")))
        c = c.join(stays, ["schema", "table"], "left_semi")
    return keyed_diff(c, d, kind)


def diff(spark: SparkSession, current: Catalog, desired: Catalog, ignore_comments: bool = False, ignore_constraint_names: bool = False) -> DataFrame:
    """All changes that lead from ``current`` to ``desired``."""
    if ignore_constraint_names:
        current, desired = _structural(current), _structural(desired)
    out = reduce(DataFrame.unionByName, (diff_kind(spark, current, desired, entity) for entity in KINDS))
    if ignore_comments:
        views = ("MODIFY_VIEW", "MODIFY_MATERIALIZED_VIEW", "MODIFY_FUNCTION")
        out = out.filter(~F.col("change_type").endswith("_COMMENT") & ~(F.col("change_type").isin(*views) & (F.col("severity") == SAFE)))
    return out


def _structural(catalog: Catalog) -> Catalog:
    """Constraints named after what they say."""
    out = Catalog({k: [dict(r) for r in rows] for k, rows in catalog.rows.items()})
    for r in out.rows["constraints"]:
        r["name"] = "|".join([r["kind"], ",".join(r["columns"] or []), r["ref_table"] or "", canonical(r["expression"] or "")]).lower()
    return out


def stats(changes: DataFrame) -> DataFrame:
    """(change_type, n)."""
    return changes.groupBy("change_type").agg(F.count("*").alias("n"))


def severity_summary(changes: DataFrame) -> DataFrame:
    """One row: how many changes there are of each severity."""
    return changes.agg(*(F.count_if(F.col("severity") == s).alias(s.lower()) for s in (SAFE, RISKY, MIGRATION, BREAKING)))


def recreate_dependents(changes: DataFrame, current: Catalog, desired: Catalog, spark: SparkSession) -> DataFrame:
    """Views, materialized views and aggregates over a table whose column changes its type are dropped and added again.

    Their modifications are replaced by the pair; dropping for this purpose is risky, not breaking.
    """
    rows = []
    for entity, label, suffix in (("views", "view", "VIEW"), ("materialized_views", "materialized view", "MATERIALIZED_VIEW"), ("aggregates", "continuous aggregate", "CONTINUOUS_AGGREGATE")):
        for r in current.rows[entity]:
            if desired.find(entity, schema=r["schema"], name=r["name"]):
                rows += [(f"{r['schema']}.{r['name']}", label, suffix, t) for t in sources(r["definition"])]
    uses = spark.createDataFrame(rows, "name string, label string, suffix string, source string")
    types = changes.filter("change_type = 'MODIFY_COLUMN_TYPE'").select("table_name").distinct()
    nulls = changes.filter("change_type = 'MODIFY_COLUMN_NULLABILITY'").select("table_name").distinct()
    hit = uses.join(types, uses.source == types.table_name, "left_semi").union(uses.filter("suffix = 'CONTINUOUS_AGGREGATE'").join(nulls, uses.source == nulls.table_name, "left_semi"))
    hit = hit.select("name", "label", "suffix").distinct()
    pair = hit.select("name", "label", "suffix", F.explode(F.array(F.lit("DROP"), F.lit("ADD"))).alias("verb")).select(
        F.concat_ws("_", "verb", "suffix").alias("change_type"), F.when(F.col("verb") == "DROP", RISKY).otherwise(SAFE).alias("severity"), F.col("label").alias("object_type"), F.col("name").alias("object_name"),
        F.lit(None).cast("string").alias("table_name"), F.lit(None).cast("string").alias("old_value"), F.lit("recreated").alias("new_value"),
    )
    rest = changes.join(hit.select(F.col("name").alias("object_name"), F.col("label").alias("object_type")), ["object_name", "object_type"], "left_anti").select(*changes.columns)
    return rest.unionByName(pair)
