"""Scans of a server's own catalog, as DataFrames of its relations, into catalog rows.

The information schema knows no indexes, functions, triggers, types, sequences' owners, partitions, materialized views or
hypertables; these scans read the relations below it. Each is one query for the whole catalog. What only the server can
spell out (an expression, a view's text) is a column of the relation as it is read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.catalog import Catalog
from tessera.sources.ddl import parse
from tessera.sources.scans import _users
from tessera.sources.scans import extract as extract_standard

Found = Mapping[str, DataFrame]

#: Columns of each relation that the scans read.
RELATIONS: dict[str, str] = {
    "pg_namespace": "oid bigint, nspname string",
    "pg_class": "oid bigint, relname string, relnamespace bigint, relkind string, relam bigint, reloptions array<string>,"
    " relispopulated boolean, bounds string, definition string, comment string",
    "pg_attribute": "attrelid bigint, attname string, attnum int, attisdropped boolean, comment string",
    "pg_inherits": "inhrelid bigint, inhparent bigint",
    "pg_partitioned_table": "partrelid bigint, partstrat string, partattrs array<int>",
    "pg_constraint": "oid bigint, conname string, contype string, conrelid bigint, conindid bigint, conkey array<int>,"
    " confrelid bigint, confkey array<int>, confupdtype string, confdeltype string, condeferrable boolean,"
    " condeferred boolean, conislocal boolean, expression string, definition string",
    "pg_index": "indexrelid bigint, indrelid bigint, indisunique boolean, indisprimary boolean,"
    " indnullsnotdistinct boolean, predicate string, definition string",
    "pg_am": "oid bigint, amname string",
    "pg_proc": "oid bigint, proname string, pronamespace bigint, prolang bigint, prokind string, proisstrict boolean,"
    " prosecdef boolean, provolatile string, prosrc string, args string, arg_types string, returns string, comment string",
    "pg_language": "oid bigint, lanname string",
    "pg_depend": "objid bigint, refobjid bigint, refobjsubid int, deptype string",
    "pg_trigger": "oid bigint, tgname string, tgrelid bigint, tgfoid bigint, tgtype int, tgattr array<int>,"
    " tgisinternal boolean, definition string",
    "pg_extension": "oid bigint, extname string, extnamespace bigint, extversion string, comment string",
    "pg_type": "oid bigint, typname string, typnamespace bigint, typtype string, typrelid bigint, definition string, comment string",
    "pg_enum": "enumtypid bigint, enumlabel string, enumsortorder double",
    "pg_sequence": "seqrelid bigint, seqstart bigint, seqmin bigint, seqmax bigint, seqincrement bigint, seqcache bigint,"
    " seqcycle boolean",
}
#: Those of hypertables, where the server has them.
TIME_RELATIONS: dict[str, str] = {
    "hypertables": "hypertable_schema string, hypertable_name string",
    "dimensions": "hypertable_schema string, hypertable_name string, dimension_number int, column_name string,"
    " time_interval string, num_partitions int",
    "compression_settings": "hypertable_schema string, hypertable_name string, attname string,"
    " segmentby_column_index int, orderby_column_index int, orderby_asc boolean",
    "jobs": "job_id int, proc_name string, schedule_interval string, config string, hypertable_schema string, hypertable_name string",
    "continuous_aggregates": "view_schema string, view_name string, hypertable_schema string, hypertable_name string,"
    " view_definition string, materialized_only boolean, materialization_hypertable_name string",
}
#: Columns that the server spells out while they are read.
DEPARSED: dict[tuple[str, str], str] = {
    ("pg_class", "bounds"): "pg_get_expr(relpartbound, oid)",
    ("pg_class", "definition"): "CASE WHEN relkind = 'm' THEN pg_get_viewdef(oid) END",
    ("pg_class", "comment"): "obj_description(oid, 'pg_class')",
    ("pg_attribute", "comment"): "col_description(attrelid, attnum)",
    ("pg_constraint", "expression"): "pg_get_expr(conbin, conrelid)",
    ("pg_constraint", "definition"): "pg_get_constraintdef(oid)",
    ("pg_index", "predicate"): "pg_get_expr(indpred, indrelid)",
    ("pg_index", "definition"): "pg_get_indexdef(indexrelid)",
    ("pg_proc", "args"): "pg_get_function_arguments(oid)",
    ("pg_proc", "arg_types"): "COALESCE((SELECT string_agg(format_type(t, NULL), ',' ORDER BY i) FROM unnest(proargtypes) WITH ORDINALITY a(t, i)), '')",
    ("pg_proc", "returns"): "pg_get_function_result(oid)",
    ("pg_proc", "comment"): "obj_description(oid, 'pg_proc')",
    ("pg_trigger", "definition"): "pg_get_triggerdef(oid)",
    ("pg_extension", "comment"): "obj_description(oid, 'pg_extension')",
    ("pg_type", "comment"): "obj_description(oid, 'pg_type')",
    ("pg_type", "definition"): "CASE typtype WHEN 'd' THEN format_type(typbasetype, typtypmod) WHEN 'c' THEN"
    " (SELECT '(' || string_agg(attname || ' ' || format_type(atttypid, atttypmod), ', ' ORDER BY attnum) || ')'"
    " FROM pg_attribute WHERE attrelid = typrelid AND NOT attisdropped) END",
}
_SERVER_TYPES = {"bigint": "bigint", "string": "text", "int": "int", "boolean": "boolean", "double": "float8", "array<int>": "int2[]::int[]", "array<string>": "text[]"}
#: What one letter stands for.
STRATEGIES = {"r": "RANGE", "l": "LIST", "h": "HASH"}
CONSTRAINTS = {"p": "PRIMARY KEY", "f": "FOREIGN KEY", "u": "UNIQUE", "c": "CHECK", "x": "EXCLUDE"}
ACTIONS = {"a": "NO ACTION", "r": "RESTRICT", "c": "CASCADE", "n": "SET NULL", "d": "SET DEFAULT"}
VOLATILITIES = {"i": "IMMUTABLE", "s": "STABLE", "v": "VOLATILE"}
TYPES = {"e": "enum", "c": "composite", "d": "domain"}
#: Bits of a trigger's type.
ROW, BEFORE, INSTEAD = 1, 2, 64
EVENTS = {"INSERT": 4, "DELETE": 8, "UPDATE": 16, "TRUNCATE": 32}


def server_query(relation: str) -> str:
    """The statement by which a relation is read from the server."""
    schema, columns = ("timescaledb_information", TIME_RELATIONS) if relation in TIME_RELATIONS else ("pg_catalog", RELATIONS)
    named = (c.strip().split(" ", 1) for c in columns[relation].split(","))
    listed = ", ".join(f"({DEPARSED.get((relation, n), n)})::{_SERVER_TYPES[t]} AS {n}" for n, t in named)
    return f"SELECT {listed} FROM {schema}.{relation}"


def probe(spark: SparkSession, url: str, **properties: str) -> dict[str, str | None]:
    """The name of the database behind a connection, and the version of its extension for hypertables, if it has one."""
    one = "SELECT current_database()::text AS name, (SELECT extversion::text FROM pg_extension WHERE extname = 'timescaledb') AS hypertables"
    return spark.read.format("jdbc").options(url=url, query=one, **properties).load().first().asDict()


def read_server(spark: SparkSession, url: str, **properties: str) -> dict[str, DataFrame]:
    """All relations that the scans read; those of hypertables only where the server has them."""
    wanted = [*RELATIONS, *(TIME_RELATIONS if probe(spark, url, **properties)["hypertables"] else ())]
    return {r: spark.read.format("jdbc").options(url=url, query=server_query(r), **properties).load() for r in wanted}


def _letter(column: str, meaning: Mapping[str, str], otherwise: str | None = None) -> Column:
    out = F.lit(otherwise).cast("string")
    for letter, text in meaning.items():
        out = F.when(F.col(column) == letter, text).otherwise(out)
    return out


def _placed(found: Found, relation: str, space: str, exclude: Sequence[str]) -> DataFrame:
    """Rows of a relation with the name of their schema, without the server's own schemas."""
    spaces = _users(found["pg_namespace"], "nspname", exclude).select(F.col("oid").alias(space), F.col("nspname").alias("schema"))
    return found[relation].join(spaces, space)


def _classes(found: Found, exclude: Sequence[str] = ()) -> DataFrame:
    return _placed(found, "pg_class", "relnamespace", exclude)


def _named(found: Found, df: DataFrame, key: str, owner: str, numbers: str, out: str) -> DataFrame:
    """(key, names of the owner's columns whose numbers an array lists, in its order); other numbers have no name."""
    names = found["pg_attribute"].filter(~F.col("attisdropped")).select(F.col("attrelid").alias(owner), F.col("attnum").alias("number"), "attname")
    listed = df.select(key, owner, F.posexplode(numbers).alias("place", "number")).join(names, [owner, "number"])
    ordered = F.array_sort(F.collect_list(F.struct("place", "attname")))
    return listed.groupBy(key).agg(ordered["attname"].alias(out))


def _or_none(column: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast("array<string>")).alias(column)


def scan_partitioning(found: Found, exclude: Sequence[str] = ()) -> DataFrame:
    """(schema, name, partition_type, partition_columns) of tables that are split; expressions have no column."""
    split = found["pg_partitioned_table"]
    columns = _named(found, split.withColumn("oid", F.col("partrelid")), "oid", "partrelid", "partattrs", "partition_columns").withColumnRenamed("oid", "partrelid")
    own = _classes(found, exclude).select(F.col("oid").alias("partrelid"), "schema", F.col("relname").alias("name"))
    joined = split.join(own, "partrelid").join(columns, "partrelid", "left")
    return joined.select("schema", "name", _letter("partstrat", STRATEGIES).alias("partition_type"), _or_none("partition_columns"))


def scan_partitions(found: Found, exclude: Sequence[str] = ()) -> DataFrame:
    """(schema, name, parent, bounds): relations joined with themselves through inheritance."""
    own = _classes(found, exclude)
    parents = own.select(F.col("oid").alias("inhparent"), F.concat_ws(".", "schema", "relname").alias("parent"))
    children = own.filter(F.col("relkind").isin("r", "p") & F.col("bounds").isNotNull())
    joined = children.withColumnRenamed("oid", "inhrelid").join(found["pg_inherits"], "inhrelid").join(parents, "inhparent")
    return joined.select("schema", F.col("relname").alias("name"), "parent", "bounds")


def scan_constraints(found: Found, exclude: Sequence[str] = ()) -> DataFrame:
    """Constraints of any kind that a table declares itself, EXCLUDE too; ``rank`` gives their customary order."""
    own = _classes(found, exclude)
    inherited = found["pg_inherits"].select(F.col("inhrelid").alias("conrelid"))
    tables = own.select(F.col("oid").alias("conrelid"), "schema", F.col("relname").alias("table"))
    targets = own.select(F.col("oid").alias("confrelid"), F.concat_ws(".", "schema", "relname").alias("ref_table"))
    rows = found["pg_constraint"].filter(F.col("conislocal") & F.col("contype").isin(*CONSTRAINTS)).join(inherited, "conrelid", "left_anti")
    columns = _named(found, rows, "oid", "conrelid", "conkey", "columns")
    refers = _named(found, rows, "oid", "confrelid", "confkey", "ref_columns")
    joined = rows.join(tables, "conrelid").join(targets, "confrelid", "left").join(columns, "oid", "left").join(refers, "oid", "left")
    foreign = F.col("contype") == "f"
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, "pfuc")), F.col("contype")), F.lit(0))
    return joined.select(
        "schema", "table", F.col("conname").alias("name"), _letter("contype", CONSTRAINTS).alias("kind"), _or_none("columns"), "ref_table", "ref_columns",
        F.when(foreign, _letter("confdeltype", ACTIONS)).alias("on_delete"), F.when(foreign, _letter("confupdtype", ACTIONS)).alias("on_update"),
        F.when(F.col("contype") == "x", F.col("definition")).otherwise(F.col("expression")).alias("expression"),
        F.col("condeferrable").alias("deferrable"), F.col("condeferred").alias("initially_deferred"),
        F.when(rank == 0, 5).otherwise(rank).cast("int").alias("rank"),
    )


def _indexes(found: Found, own: DataFrame) -> DataFrame:
    """Indexes of some relations, but for those that belong to a constraint."""
    tables = own.select(F.col("oid").alias("indrelid"), F.col("schema").alias("table_schema"), F.col("relname").alias("table"))
    methods = found["pg_am"].select(F.col("oid").alias("relam"), F.col("amname").alias("method"))
    index = found["pg_index"].select("indexrelid", "indrelid", "indisunique", "indisprimary", "indnullsnotdistinct", "predicate", F.col("definition").alias("text"))
    joined = own.select(F.col("oid").alias("indexrelid"), "schema", "relname", "relam", "reloptions").join(index, "indexrelid").join(tables, "indrelid").join(methods, "relam")
    kept = joined.filter(~F.col("indisprimary")).join(found["pg_constraint"].select(F.col("conindid").alias("indexrelid")), "indexrelid", "left_anti")
    pairs = F.transform("reloptions", lambda o: F.struct(F.regexp_extract(o, r"^([^=]*)", 1).alias("key"), F.regexp_extract(o, r"^[^=]*=(.*)$", 1).alias("value")))
    return kept.select(
        "schema", "table", F.col("relname").alias("name"), "method", F.col("indisunique").alias("is_unique"),
        F.coalesce("indnullsnotdistinct", F.lit(False)).alias("nulls_not_distinct"), "predicate", F.col("text").alias("definition"),
        F.map_from_entries(F.coalesce(pairs, F.array().cast("array<struct<key:string,value:string>>"))).alias("params"),
    )


def scan_indexes(found: Found, exclude: Sequence[str] = ()) -> DataFrame:
    """Indexes that are declared: none that belongs to a constraint, nor that which a hypertable gets for each dimension."""
    kept = _indexes(found, _classes(found, exclude))
    if "dimensions" not in found:
        return kept
    made = found["dimensions"].select(*_hypertable(), F.concat_ws("_", "hypertable_name", "column_name", F.lit("idx")).alias("name"))
    return kept.join(made, ["schema", "table", "name"], "left_anti")


def scan_materialized_views(found: Found, exclude: Sequence[str] = ()) -> DataFrame:
    own = _classes(found, exclude).filter(F.col("relkind") == "m")
    return own.select("schema", F.col("relname").alias("name"), F.rtrim(F.regexp_replace("definition", r";\s*$", "")).alias("definition"), F.col("relispopulated").alias("with_data"), "comment")


def scan_functions(found: Found, exclude: Sequence[str] = ()) -> DataFrame:
    """Functions and procedures that no extension owns."""
    owned = found["pg_depend"].filter(F.col("deptype") == "e").select(F.col("objid").alias("oid"))
    languages = found["pg_language"].select(F.col("oid").alias("prolang"), F.col("lanname").alias("language"))
    rows = _placed(found, "pg_proc", "pronamespace", exclude).filter(F.col("prokind").isin("f", "p")).join(owned, "oid", "left_anti").join(languages, "prolang")
    return rows.select(
        "schema", F.col("proname").alias("name"), "args", "arg_types", "returns", "language", _letter("provolatile", VOLATILITIES).alias("volatility"),
        F.col("proisstrict").alias("strict"), F.col("prosecdef").alias("security_definer"), F.col("prosrc").alias("body"), "comment",
    )


def scan_triggers(found: Found, exclude: Sequence[str] = ()) -> DataFrame:
    """Triggers with what the bits of their type say; events by name."""
    bit = lambda n: F.col("tgtype").bitwiseAND(n) != 0
    tables = _classes(found, exclude).select(F.col("oid").alias("tgrelid"), "schema", F.col("relname").alias("table"))
    called = found["pg_proc"].join(found["pg_namespace"].select(F.col("oid").alias("pronamespace"), "nspname"), "pronamespace")
    called = called.select(F.col("oid").alias("tgfoid"), F.concat_ws(".", "nspname", "proname").alias("function"))
    rows = found["pg_trigger"].filter(~F.col("tgisinternal"))
    joined = rows.join(tables, "tgrelid").join(called, "tgfoid").join(_named(found, rows, "oid", "tgrelid", "tgattr", "update_columns"), "oid", "left")
    events = F.array_compact(F.array(*(F.when(bit(n), name) for name, n in sorted(EVENTS.items()))))
    return joined.select(
        "schema", "table", F.col("tgname").alias("name"), F.when(bit(BEFORE), "BEFORE").when(bit(INSTEAD), "INSTEAD OF").otherwise("AFTER").alias("timing"),
        events.alias("events"), _or_none("update_columns"), bit(ROW).alias("per_row"), "function", "definition",
    )


def scan_extensions(found: Found, without: Sequence[str] = ("plpgsql",)) -> DataFrame:
    spaces = found["pg_namespace"].select(F.col("oid").alias("extnamespace"), F.col("nspname").alias("schema"))
    rows = found["pg_extension"].join(spaces, "extnamespace")
    rows = rows.filter(~F.col("extname").isin(*without)) if without else rows
    return rows.select(F.col("extname").alias("name"), "schema", F.col("extversion").alias("version"), "comment")


def scan_types(found: Found, exclude: Sequence[str] = ()) -> DataFrame:
    """Enums with their labels in order, composite types and domains; not the row types of relations."""
    relations = found["pg_class"].filter(F.col("relkind").isin("r", "v", "m", "f", "p")).select(F.col("relnamespace").alias("typnamespace"), F.col("relname").alias("typname"))
    own = _placed(found, "pg_type", "typnamespace", exclude).filter(F.col("typtype").isin(*TYPES)).join(relations, ["typnamespace", "typname"], "left_anti")
    labels = found["pg_enum"].groupBy(F.col("enumtypid").alias("oid")).agg(F.array_sort(F.collect_list(F.struct("enumsortorder", "enumlabel")))["enumlabel"].alias("labels"))
    return own.join(labels, "oid", "left").select("schema", F.col("typname").alias("name"), _letter("typtype", TYPES).alias("kind"), "definition", _or_none("labels"), "comment")


def scan_sequences(found: Found, exclude: Sequence[str] = ()) -> DataFrame:
    """Sequences that stand alone; those that a column owns come and go with it."""
    owned = found["pg_depend"].filter(F.col("deptype").isin("a", "i") & (F.col("refobjsubid") > 0)).select(F.col("objid").alias("oid"))
    own = _classes(found, exclude).filter(F.col("relkind") == "S").join(owned, "oid", "left_anti")
    joined = own.join(found["pg_sequence"].withColumnRenamed("seqrelid", "oid"), "oid")
    return joined.select(
        "schema", F.col("relname").alias("name"), F.col("seqstart").alias("start"), F.col("seqmin").alias("min_value"), F.col("seqmax").alias("max_value"),
        F.col("seqincrement").alias("increment"), F.col("seqcache").alias("cache"), F.col("seqcycle").alias("cycle"),
    )


# ---- hypertables

def _hypertable(out: str = "table") -> list[Column]:
    return [F.col("hypertable_schema").alias("schema"), F.col("hypertable_name").alias(out)]


def scan_hypertables(found: Found) -> DataFrame:
    """Hypertables with their time dimension, the first, and their space dimension, the next, if any."""
    keys = ["hypertable_schema", "hypertable_name"]
    first = found["dimensions"].filter("dimension_number = 1").select(*keys, F.col("column_name").alias("time_column"), F.col("time_interval").alias("chunk_interval"))
    later = found["dimensions"].filter("dimension_number > 1").groupBy(*keys).agg(F.min_by(F.struct("column_name", "num_partitions"), "dimension_number").alias("space"))
    joined = found["hypertables"].join(first, keys).join(later, keys, "left")
    return joined.select(*_hypertable(), "time_column", "chunk_interval", F.col("space.column_name").alias("space_column"), F.col("space.num_partitions").alias("space_partitions"))


def _jobs(found: Found, procedure: str) -> DataFrame:
    """The first job of a kind for each hypertable, which its configuration or else the job names."""
    named = [F.coalesce(F.get_json_object("config", f"$.{k}"), F.col(k)).alias(k) for k in ("hypertable_schema", "hypertable_name")]
    rows = found["jobs"].filter(F.col("proc_name") == procedure).select("job_id", "config", "schedule_interval", *named)
    return rows.groupBy("hypertable_schema", "hypertable_name").agg(F.min_by(F.struct("config", "schedule_interval"), "job_id").alias("job"))


def scan_compression(found: Found) -> DataFrame:
    """Hypertables that have settings of compression: segment and order columns in order, and the policy's age."""
    keys = ["hypertable_schema", "hypertable_name"]
    direction = F.concat_ws(" ", "attname", F.when(F.col("orderby_asc"), "asc").otherwise("desc"))
    listed = lambda at, value: F.array_sort(F.collect_list(F.when(F.col(at).isNotNull(), F.struct(F.col(at).alias("at"), value.alias("value")))))["value"]
    settings = found["compression_settings"].groupBy(*keys).agg(listed("segmentby_column_index", F.col("attname")).alias("segment_by"), listed("orderby_column_index", direction).alias("order_by"))
    joined = settings.join(_jobs(found, "policy_compression"), keys, "left")
    return joined.select(*_hypertable(), "segment_by", "order_by", F.get_json_object("job.config", "$.compress_after").alias("compress_after"))


def scan_retention(found: Found) -> DataFrame:
    return _jobs(found, "policy_retention").select(*_hypertable(), F.get_json_object("job.config", "$.drop_after").alias("drop_after"), F.col("job.schedule_interval").alias("schedule"))


def scan_aggregates(found: Found, exclude: Sequence[str] = ()) -> DataFrame:
    """Continuous aggregates with the comment of their view."""
    comments = _classes(found, exclude).select(F.col("schema").alias("view_schema"), F.col("relname").alias("view_name"), "comment")
    rows = _users(found["continuous_aggregates"], "view_schema", exclude).join(comments, ["view_schema", "view_name"], "left")
    return rows.select(F.col("view_schema").alias("schema"), F.col("view_name").alias("name"), F.concat_ws(".", "hypertable_schema", "hypertable_name").alias("source"), F.rtrim(F.regexp_replace("view_definition", r";\s*$", "")).alias("definition"), "comment")


def scan_refreshes(found: Found, exclude: Sequence[str] = ()) -> DataFrame:
    """Refresh policies by the number of the hypertable that holds their aggregate: an equi join, not all pairs."""
    number = F.regexp_extract("materialization_hypertable_name", r"_materialized_hypertable_(\d+)", 1)
    views = _users(found["continuous_aggregates"], "view_schema", exclude).select(F.col("view_schema").alias("schema"), F.col("view_name").alias("name"), number.try_cast("int").alias("id"))
    jobs = found["jobs"].filter(F.col("proc_name") == "policy_refresh_continuous_aggregate")
    jobs = jobs.groupBy(F.get_json_object("config", "$.mat_hypertable_id").try_cast("int").alias("id")).agg(F.min_by(F.struct("config", "schedule_interval"), "job_id").alias("job"))
    of = lambda k: F.get_json_object("job.config", f"$.{k}").alias(k)
    return views.join(jobs, "id").select("schema", "name", of("start_offset"), of("end_offset"), F.col("job.schedule_interval").alias("schedule"))


def scan_aggregate_indexes(found: Found, exclude: Sequence[str] = ()) -> DataFrame:
    """Indexes of the hypertables behind aggregates, as indexes of these."""
    spaces = found["pg_namespace"].select(F.col("oid").alias("relnamespace"), F.col("nspname").alias("schema"))
    every = _indexes(found, found["pg_class"].join(spaces, "relnamespace"))
    views = _users(found["continuous_aggregates"], "view_schema", exclude).select(F.col("materialization_hypertable_name").alias("table"), "view_schema", "view_name")
    return every.join(views, "table").select(F.col("view_schema").alias("schema"), F.col("view_name").alias("table"), "name", "method", "is_unique", "nulls_not_distinct", "predicate", "definition", "params")


# ---- all of it


def scans(found: Found, exclude: Sequence[str] = ()) -> dict[str, DataFrame]:
    """All scans whose relations are there, by kind of entity."""
    every = {
        "extensions": scan_extensions(found), "types": scan_types(found, exclude), "sequences": scan_sequences(found, exclude), "partitions": scan_partitions(found, exclude),
        "constraints": scan_constraints(found, exclude), "indexes": scan_indexes(found, exclude), "materialized_views": scan_materialized_views(found, exclude),
        "functions": scan_functions(found, exclude), "triggers": scan_triggers(found, exclude),
    }
    if "hypertables" in found:
        every |= {"hypertables": scan_hypertables(found), "compression": scan_compression(found), "retention": scan_retention(found), "aggregates": scan_aggregates(found, exclude), "refreshes": scan_refreshes(found, exclude)}
    return every


def _declared(text: str, entity: str) -> dict:
    """What the statement that the server gives for an index or a trigger says."""
    rows = parse(text, errors=[]).rows[entity]
    return rows[0] if rows else {}


def extract(standard: Found, found: Found, exclude: Sequence[str] = ()) -> Catalog:
    """The whole catalog: the information schema's part, and what only the server's own relations tell. A catalog is small;
    its rows are collected once the scans are done."""
    catalog = extract_standard(standard, exclude)
    catalog.rows.pop("constraints", None)
    for kind, df in scans(found, exclude).items():
        for row in (r.asDict(recursive=True) for r in df.collect()):
            row.pop("rank", None)
            text = row.pop("definition", None) if kind in ("indexes", "triggers") else None
            if kind == "indexes":
                said = _declared(text, kind)
                row |= {"columns": said.get("columns") or [], "include": said.get("include") or []}
            elif kind == "triggers":
                row["condition"] = _declared(text, kind).get("condition")
            elif kind == "aggregates":
                row["with_data"] = True
            catalog.put(kind, **row)
    if "hypertables" in found:
        for row in (r.asDict(recursive=True) for r in scan_aggregate_indexes(found, exclude).collect()):
            said = _declared(row.pop("definition"), "indexes")
            catalog.put("indexes", **row, columns=said.get("columns") or [], include=said.get("include") or [])
    split = {(r.schema, r.name): r for r in scan_partitioning(found, exclude).collect()}
    children = {(p["schema"], p["name"]) for p in catalog.rows["partitions"]}
    views = {(a["schema"], a["name"]) for a in catalog.rows["aggregates"]}
    catalog.rows["tables"] = [t for t in catalog.rows["tables"] if (t["schema"], t["name"]) not in children]
    catalog.rows["columns"] = [c for c in catalog.rows["columns"] if (c["schema"], c["table"]) not in children]
    catalog.rows["views"] = [v for v in catalog.rows["views"] if (v["schema"], v["name"]) not in views]
    for t in catalog.rows["tables"]:
        if p := split.get((t["schema"], t["name"])):
            t |= {"partition_type": p.partition_type, "partition_columns": list(p.partition_columns)}
    return catalog
