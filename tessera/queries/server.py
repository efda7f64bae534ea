"""The scans of a server's catalog over a small one, with SQL that is written by hand as a server's client would write it."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

from tessera.queries.registry import query
from tessera.sources import server as S

_MAT = "_materialized_hypertable_7"
#: Rows of each relation; columns as in ``RELATIONS`` and ``TIME_RELATIONS``.
ROWS: dict[str, list[tuple]] = {
    "pg_namespace": [(1, "app"), (2, "pg_catalog"), (3, "_timescaledb_internal"), (4, "public")],
    "pg_class": [
        (10, "users", 1, "r", 0, None, True, None, None, "people"), (11, "logs", 1, "p", 0, None, True, None, None, None),
        (12, "logs_a", 1, "r", 0, None, True, "FOR VALUES FROM (1) TO (9)", None, None), (13, "logs_b", 4, "r", 0, None, True, "DEFAULT", None, None),
        (14, "pg_class", 2, "r", 0, None, True, None, None, None), (15, "metrics", 4, "r", 0, None, True, None, None, None),
        (16, "by_hour", 4, "v", 0, None, True, None, None, "hourly"), (17, _MAT, 3, "r", 0, None, True, None, None, None),
        (20, "users_pkey", 1, "i", 90, None, True, None, None, None), (21, "users_name_idx", 1, "i", 91, ["fillfactor=70", "buffering=auto"], True, None, None, None),
        (22, "metrics_at_idx", 4, "i", 90, None, True, None, None, None), (23, "metrics_u_idx", 4, "i", 90, [], True, None, None, None),
        (24, "mat_idx", 3, "i", 90, None, True, None, None, None), (30, "top", 1, "m", 0, None, False, None, " SELECT 1;", "best"),
        (31, "ids", 1, "S", 0, None, True, None, None, None), (32, "users_id_seq", 1, "S", 0, None, True, None, None, None), (33, "pair", 1, "c", 0, None, True, None, None, None),
    ],
    "pg_attribute": [
        (10, "id", 1, False, None), (10, "name", 2, False, None), (10, "gone", 3, True, None), (10, "boss", 4, False, None),
        (11, "at", 1, False, None), (11, "kind", 2, False, None), (12, "at", 1, False, None), (15, "at", 1, False, None), (15, "v", 2, False, None),
    ],
    "pg_inherits": [(12, 11), (13, 11)],
    "pg_partitioned_table": [(11, "r", [2, 0, 1])],
    "pg_constraint": [
        (40, "users_pkey", "p", 10, 20, [1], 0, None, None, None, False, False, True, None, "PRIMARY KEY (id)"),
        (41, "boss_fk", "f", 10, 0, [4, 2], 10, [1, 2], "a", "c", True, True, True, None, "FOREIGN KEY"),
        (42, "named", "c", 10, 0, [2], 0, None, None, None, False, False, True, "(name <> ''::text)", "CHECK (...)"),
        (43, "apart", "x", 11, 0, [1], 0, None, None, None, False, False, True, None, "EXCLUDE USING gist (at WITH &&)"),
        (44, "inherited", "c", 12, 0, [1], 0, None, None, None, False, False, True, "at > 0", "CHECK (...)"),
        (45, "away", "c", 11, 0, [1], 0, None, None, None, False, False, False, "at > 0", "CHECK (...)"),
        (46, "sees", "t", 11, 0, [1], 0, None, None, None, False, False, True, None, "TRIGGER"),
    ],
    "pg_index": [
        (20, 10, True, True, False, None, "CREATE UNIQUE INDEX users_pkey ON app.users USING btree (id)"),
        (21, 10, False, False, None, "(id > 5)", "CREATE INDEX users_name_idx ON app.users USING gin (name DESC, lower(name)) INCLUDE (id) WHERE (id > 5)"),
        (22, 15, False, False, False, None, "CREATE INDEX metrics_at_idx ON public.metrics USING btree (at DESC)"),
        (23, 15, True, False, True, None, "CREATE UNIQUE INDEX metrics_u_idx ON public.metrics USING btree (v) NULLS NOT DISTINCT"),
        (24, 17, False, False, False, None, f"CREATE INDEX mat_idx ON _timescaledb_internal.{_MAT} USING btree (hour)"),
    ],
    "pg_am": [(90, "btree"), (91, "gin")],
    "pg_proc": [
        (50, "touch", 1, 60, "f", False, True, "v", "BEGIN RETURN NEW; END", "", "", "trigger", "touches"),
        (51, "add", 4, 61, "f", True, False, "i", "SELECT a + b", "a integer, b integer", "integer,integer", "integer", None),
        (52, "owned", 4, 61, "f", True, False, "i", "", "", "", "integer", None), (53, "total", 4, 61, "a", True, False, "i", "", "", "", "integer", None),
        (54, "run", 4, 61, "p", False, False, "s", "SELECT 1", "", "", None, None), (55, "now", 2, 61, "f", True, False, "s", "now", "", "", "timestamp", None),
    ],
    "pg_language": [(60, "plpgsql"), (61, "sql")],
    "pg_depend": [(52, 70, 0, "e"), (32, 10, 1, "a"), (31, 1, 0, "n"), (51, 1, 0, "n")],
    "pg_trigger": [
        (80, "touch_it", 10, 50, 1 | 2 | 4 | 16, [4, 2], False, "CREATE TRIGGER touch_it BEFORE INSERT OR UPDATE OF boss, name ON app.users FOR EACH ROW WHEN ((new.id > 0)) EXECUTE FUNCTION app.touch()"),
        (81, "after_all", 10, 50, 8 | 32, [], False, "CREATE TRIGGER after_all AFTER DELETE OR TRUNCATE ON app.users FOR EACH STATEMENT EXECUTE FUNCTION app.touch()"),
        (82, "instead", 16, 50, 64 | 1 | 4, [], False, "CREATE TRIGGER instead INSTEAD OF INSERT ON public.by_hour FOR EACH ROW EXECUTE FUNCTION app.touch()"),
        (83, "inner", 10, 50, 5, [], True, ""),
    ],
    "pg_extension": [(70, "plpgsql", 2, "1.0", None), (71, "timescaledb", 4, "2.14.0", "time")],
    "pg_type": [
        (75, "mood", 1, "e", 0, None, "moods"), (76, "pair", 1, "c", 33, "(a integer, b text)", None), (77, "users", 1, "c", 10, "(id integer)", None),
        (78, "positive", 4, "d", 0, "integer", None), (79, "empty", 4, "e", 0, None, None), (74, "text", 2, "b", 0, None, None),
    ],
    "pg_enum": [(75, "sad", 2.0), (75, "glad", 1.0), (75, "mad", 1.5)],
    "pg_sequence": [(31, 5, 1, 100, 2, 10, True), (32, 1, 1, 2147483647, 1, 1, False)],
    "hypertables": [("public", "metrics"), ("app", "other")],
    "dimensions": [("public", "metrics", 1, "at", "7 days", None), ("public", "metrics", 2, "v", None, 4), ("public", "metrics", 3, "w", None, 8), ("app", "other", 1, "t", "1 day", None)],
    "compression_settings": [("public", "metrics", "v", 1, None, None), ("public", "metrics", "w", 2, None, None), ("public", "metrics", "at", None, 1, False), ("public", "metrics", "id", None, 2, True), ("app", "other", "t", None, 1, True)],
    "jobs": [
        (3, "policy_retention", "1 day", json.dumps({"drop_after": "90 days", "hypertable_id": 1}), "public", "metrics"),
        (2, "policy_retention", "2 days", json.dumps({"drop_after": "30 days", "hypertable_schema": "app", "hypertable_name": "other"}), None, None),
        (4, "policy_retention", "9 days", json.dumps({"drop_after": "1 day"}), "app", "other"),
        (5, "policy_compression", "12 hours", json.dumps({"compress_after": "7 days"}), "public", "metrics"),
        (6, "policy_refresh_continuous_aggregate", "01:00:00", json.dumps({"start_offset": "3 days", "end_offset": None, "mat_hypertable_id": 7}), None, None),
        (7, "policy_refresh_continuous_aggregate", "02:00:00", json.dumps({"start_offset": "9 days", "mat_hypertable_id": 70}), None, None),
    ],
    "continuous_aggregates": [("public", "by_hour", "public", "metrics", " SELECT time_bucket('1 hour', at) AS hour FROM metrics GROUP BY 1;", True, _MAT)],
}
_EVERY = {**S.RELATIONS, **S.TIME_RELATIONS}
_DUCK = {"bigint": "BIGINT", "string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE", "array<int>": "INTEGER[]", "array<string>": "VARCHAR[]"}


class Relations(Mapping):
    """The relations as DataFrames, made when they are asked for."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.createDataFrame(ROWS[name], _EVERY[name]).coalesce(1)

    def __iter__(self) -> Iterator[str]:
        return iter(_EVERY)

    def __len__(self) -> int:
        return len(_EVERY)


relations = Relations


def _value(v) -> str:
    if isinstance(v, list):
        return "[" + ", ".join(map(_value, v)) + "]"
    if v is None or isinstance(v, bool):
        return {None: "NULL", True: "TRUE", False: "FALSE"}[v]
    return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def _sql(body: str) -> str:
    """A query over the relations that it names."""
    parts = []
    for name in (r for r in _EVERY if r in body):
        columns = [c.strip().split(" ", 1) for c in _EVERY[name].split(",")]
        casts = ", ".join(f"CAST(x{i} AS {_DUCK[t]}) AS {n}" for i, (n, t) in enumerate(columns))
        values = ", ".join("(" + ", ".join(map(_value, row)) + ")" for row in ROWS[name])
        parts.append(f"{name} AS (SELECT {casts} FROM (VALUES {values}) v({', '.join(f'x{i}' for i in range(len(columns)))}))")
    return f"WITH {', '.join(parts)} {body}"


_USERS = "NOT IN ('information_schema', 'pg_catalog', 'pg_toast', '_timescaledb_internal')"


@query(_sql("""SELECT n.nspname AS schema, c.relname AS name, CASE p.partstrat WHEN 'r' THEN 'RANGE' WHEN 'l' THEN 'LIST' ELSE 'HASH' END AS partition_type,
    coalesce((SELECT list(a.attname ORDER BY list_position(p.partattrs, a.attnum)) FROM pg_attribute a WHERE a.attrelid = c.oid AND list_contains(p.partattrs, a.attnum) AND NOT a.attisdropped), []) AS partition_columns
    FROM pg_partitioned_table p JOIN pg_class c ON c.oid = p.partrelid JOIN pg_namespace n ON n.oid = c.relnamespace"""))  # fmt: skip
def scan_partitioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scan_partitioning(relations(spark))


@query(_sql("""SELECT m.nspname AS schema, b.relname AS name, n.nspname || '.' || a.relname AS parent, b.bounds FROM pg_inherits i JOIN pg_class a ON a.oid = i.inhparent
    JOIN pg_namespace n ON n.oid = a.relnamespace JOIN pg_class b ON b.oid = i.inhrelid JOIN pg_namespace m ON m.oid = b.relnamespace"""))  # fmt: skip
def scan_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scan_partitions(relations(spark))


_ACTION = "CASE WHEN k.contype = 'f' THEN CASE k.{} WHEN 'a' THEN 'NO ACTION' WHEN 'r' THEN 'RESTRICT' WHEN 'c' THEN 'CASCADE' WHEN 'n' THEN 'SET NULL' WHEN 'd' THEN 'SET DEFAULT' END END"


@query(_sql(f"""SELECT n.nspname AS schema, c.relname AS "table", k.conname AS name, CASE k.contype WHEN 'p' THEN 'PRIMARY KEY' WHEN 'f' THEN 'FOREIGN KEY' WHEN 'u' THEN 'UNIQUE' WHEN 'c' THEN 'CHECK' WHEN 'x' THEN 'EXCLUDE' END AS kind,
    (SELECT list(a.attname ORDER BY list_position(k.conkey, a.attnum)) FROM pg_attribute a WHERE a.attrelid = k.conrelid AND list_contains(k.conkey, a.attnum)) AS columns,
    m.nspname || '.' || f.relname AS ref_table, (SELECT list(a.attname ORDER BY list_position(k.confkey, a.attnum)) FROM pg_attribute a WHERE a.attrelid = k.confrelid AND list_contains(k.confkey, a.attnum)) AS ref_columns,
    {_ACTION.format('confdeltype')} AS on_delete, {_ACTION.format('confupdtype')} AS on_update, CASE WHEN k.contype = 'x' THEN k.definition ELSE k.expression END AS expression,
    k.condeferrable AS deferrable, k.condeferred AS initially_deferred, CASE k.contype WHEN 'p' THEN 1 WHEN 'f' THEN 2 WHEN 'u' THEN 3 WHEN 'c' THEN 4 ELSE 5 END::INTEGER AS rank
    FROM pg_constraint k JOIN pg_class c ON c.oid = k.conrelid JOIN pg_namespace n ON n.oid = c.relnamespace LEFT JOIN pg_class f ON f.oid = k.confrelid LEFT JOIN pg_namespace m ON m.oid = f.relnamespace
    WHERE k.conislocal AND k.contype IN ('p', 'f', 'u', 'c', 'x') AND NOT EXISTS (SELECT 1 FROM pg_inherits i WHERE i.inhrelid = k.conrelid)"""))  # fmt: skip
def scan_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scan_constraints(relations(spark)).orderBy("schema", "table", "rank", "name")


_INDEXES = """FROM pg_index x JOIN pg_class c ON c.oid = x.indexrelid JOIN pg_namespace n ON n.oid = c.relnamespace JOIN pg_class t ON t.oid = x.indrelid JOIN pg_am m ON m.oid = c.relam
    WHERE NOT x.indisprimary AND NOT EXISTS (SELECT 1 FROM pg_constraint k WHERE k.conindid = c.oid)"""


@query(_sql(f"""SELECT n.nspname AS schema, t.relname AS "table", c.relname AS name, m.amname AS method, x.indisunique AS is_unique, coalesce(x.indnullsnotdistinct, FALSE) AS nulls_not_distinct, x.predicate, x.definition {_INDEXES}
    AND n.nspname {_USERS} AND c.relname NOT IN (SELECT d.hypertable_name || '_' || d.column_name || '_idx' FROM dimensions d WHERE d.hypertable_schema = n.nspname AND d.hypertable_name = t.relname)"""))  # fmt: skip
def scan_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scan_indexes(relations(spark)).drop("params")


@query(_sql(f"""SELECT n.nspname AS schema, c.relname AS name, split_part(o, '=', 1) AS option, split_part(o, '=', 2) AS value FROM (SELECT relname, relnamespace, unnest(reloptions) AS o FROM pg_class WHERE relkind = 'i') c
    JOIN pg_namespace n ON n.oid = c.relnamespace WHERE n.nspname {_USERS}"""))  # fmt: skip
def scan_index_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scan_indexes(relations(spark)).selectExpr("schema", "name", "explode(params) AS (option, value)")


@query(_sql(f"""SELECT n.nspname AS schema, c.relname AS name, rtrim(trim(c.definition, ' '), ';') AS definition, c.relispopulated AS with_data, c.comment FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace WHERE c.relkind = 'm' AND n.nspname {_USERS}"""))
def scan_materialized_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scan_materialized_views(relations(spark)).selectExpr("schema", "name", "ltrim(definition) AS definition", "with_data", "comment")


@query(_sql(f"""SELECT n.nspname AS schema, p.proname AS name, p.args, p.arg_types, p.returns, l.lanname AS language, CASE p.provolatile WHEN 'i' THEN 'IMMUTABLE' WHEN 's' THEN 'STABLE' ELSE 'VOLATILE' END AS volatility,
    p.proisstrict AS strict, p.prosecdef AS security_definer, p.prosrc AS body, p.comment FROM pg_proc p JOIN pg_namespace n ON n.oid = p.pronamespace JOIN pg_language l ON l.oid = p.prolang
    WHERE n.nspname {_USERS} AND p.prokind <> 'a' AND p.oid NOT IN (SELECT objid FROM pg_depend WHERE deptype = 'e')"""))  # fmt: skip
def scan_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scan_functions(relations(spark))


@query(_sql("""SELECT n.nspname AS schema, c.relname AS "table", t.tgname AS name, CASE WHEN t.tgtype & 2 = 2 THEN 'BEFORE' WHEN t.tgtype & 64 = 64 THEN 'INSTEAD OF' ELSE 'AFTER' END AS timing,
    list_filter([CASE WHEN t.tgtype & 8 = 8 THEN 'DELETE' END, CASE WHEN t.tgtype & 4 = 4 THEN 'INSERT' END, CASE WHEN t.tgtype & 32 = 32 THEN 'TRUNCATE' END, CASE WHEN t.tgtype & 16 = 16 THEN 'UPDATE' END], lambda e: e IS NOT NULL) AS events,
    coalesce((SELECT list(a.attname ORDER BY list_position(t.tgattr, a.attnum)) FROM pg_attribute a WHERE a.attrelid = t.tgrelid AND list_contains(t.tgattr, a.attnum)), []) AS update_columns,
    t.tgtype % 2 = 1 AS per_row, m.nspname || '.' || p.proname AS function FROM pg_trigger t JOIN pg_class c ON c.oid = t.tgrelid JOIN pg_namespace n ON n.oid = c.relnamespace JOIN pg_proc p ON p.oid = t.tgfoid
    JOIN pg_namespace m ON m.oid = p.pronamespace WHERE NOT t.tgisinternal"""))  # fmt: skip
def scan_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scan_triggers(relations(spark)).drop("definition")


@query(_sql("SELECT e.extname AS name, n.nspname AS schema, e.extversion AS version, e.comment FROM pg_extension e JOIN pg_namespace n ON n.oid = e.extnamespace WHERE e.extname NOT IN ('plpgsql')"))
def scan_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scan_extensions(relations(spark))


@query(_sql(f"""SELECT n.nspname AS schema, t.typname AS name, CASE t.typtype WHEN 'e' THEN 'enum' WHEN 'c' THEN 'composite' ELSE 'domain' END AS kind, t.definition, t.comment,
    coalesce((SELECT list(e.enumlabel ORDER BY e.enumsortorder) FROM pg_enum e WHERE e.enumtypid = t.oid), []) AS labels FROM pg_type t JOIN pg_namespace n ON n.oid = t.typnamespace
    WHERE t.typtype IN ('e', 'c', 'd') AND n.nspname {_USERS} AND NOT EXISTS (SELECT 1 FROM pg_class c WHERE c.relnamespace = t.typnamespace AND c.relname = t.typname AND c.relkind IN ('r', 'v', 'm', 'f', 'p'))"""))  # fmt: skip
def scan_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scan_types(relations(spark))


@query(_sql("""SELECT n.nspname AS schema, c.relname AS name, s.seqstart AS start, s.seqmin AS min_value, s.seqmax AS max_value, s.seqincrement AS increment, s.seqcache AS cache, s.seqcycle AS cycle
    FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace JOIN pg_sequence s ON s.seqrelid = c.oid LEFT JOIN pg_depend d ON d.objid = c.oid AND d.deptype IN ('a', 'i') WHERE c.relkind = 'S' AND d.objid IS NULL"""))  # fmt: skip
def scan_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scan_sequences(relations(spark))


@query(_sql("""SELECT h.hypertable_schema AS schema, h.hypertable_name AS "table", d.column_name AS time_column, d.time_interval AS chunk_interval, s.column_name AS space_column, s.num_partitions AS space_partitions FROM hypertables h
    JOIN dimensions d ON d.hypertable_schema = h.hypertable_schema AND d.hypertable_name = h.hypertable_name AND d.dimension_number = 1
    LEFT JOIN dimensions s ON s.hypertable_schema = h.hypertable_schema AND s.hypertable_name = h.hypertable_name AND s.dimension_number = 2"""))  # fmt: skip
def scan_hypertables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scan_hypertables(relations(spark))


@query(_sql("""SELECT c.hypertable_schema AS schema, c.hypertable_name AS "table", coalesce(string_agg(c.attname, ', ' ORDER BY c.segmentby_column_index) FILTER (WHERE c.segmentby_column_index IS NOT NULL), '') AS segment_by,
    string_agg(c.attname || CASE WHEN c.orderby_asc THEN ' asc' ELSE ' desc' END, ', ' ORDER BY c.orderby_column_index) FILTER (WHERE c.orderby_column_index IS NOT NULL) AS order_by,
    max(json_extract_string(j.config, '$.compress_after')) AS compress_after FROM compression_settings c
    LEFT JOIN jobs j ON j.proc_name = 'policy_compression' AND j.hypertable_schema = c.hypertable_schema AND j.hypertable_name = c.hypertable_name GROUP BY 1, 2"""))  # fmt: skip
def scan_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scan_compression(relations(spark)).selectExpr("schema", "`table`", "array_join(segment_by, ', ') AS segment_by", "array_join(order_by, ', ') AS order_by", "compress_after")


@query(_sql("""SELECT h.hypertable_schema AS schema, h.hypertable_name AS "table", EXISTS (SELECT 1 FROM compression_settings c WHERE c.hypertable_schema = h.hypertable_schema AND c.hypertable_name = h.hypertable_name) AS enabled FROM hypertables h"""))
def scan_compression_enabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relations(spark)
    return S.scan_hypertables(found).join(S.scan_compression(found), ["schema", "table"], "left").selectExpr("schema", "`table`", "order_by IS NOT NULL AS enabled")


@query(_sql("""SELECT schema, "table", drop_after, schedule FROM (SELECT coalesce(json_extract_string(config, '$.hypertable_schema'), hypertable_schema) AS schema, coalesce(json_extract_string(config, '$.hypertable_name'), hypertable_name) AS "table",
    json_extract_string(config, '$.drop_after') AS drop_after, schedule_interval AS schedule, job_id FROM jobs WHERE proc_name = 'policy_retention') r QUALIFY row_number() OVER (PARTITION BY schema, "table" ORDER BY job_id) = 1"""))  # fmt: skip
def scan_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scan_retention(relations(spark))


@query(_sql("""SELECT a.view_schema AS schema, a.view_name AS name, a.hypertable_schema || '.' || a.hypertable_name AS source, rtrim(trim(a.view_definition), ';') AS definition,
    (SELECT c.comment FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace WHERE c.relname = a.view_name AND n.nspname = a.view_schema) AS comment FROM continuous_aggregates a"""))  # fmt: skip
def scan_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scan_aggregates(relations(spark)).selectExpr("schema", "name", "source", "ltrim(definition) AS definition", "comment")


@query(_sql("""SELECT a.view_schema AS schema, a.view_name AS name, json_extract_string(j.config, '$.start_offset') AS start_offset, json_extract_string(j.config, '$.end_offset') AS end_offset, j.schedule_interval AS schedule
    FROM jobs j CROSS JOIN continuous_aggregates a WHERE j.proc_name = 'policy_refresh_continuous_aggregate'
    AND json_extract_string(j.config, '$.mat_hypertable_id')::INTEGER = regexp_extract(a.materialization_hypertable_name, '_materialized_hypertable_([0-9]+)', 1)::INTEGER"""))  # fmt: skip
def scan_refreshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scan_refreshes(relations(spark))


@query(_sql(f"""SELECT a.view_schema AS schema, a.view_name AS "table", c.relname AS name, m.amname AS method, x.indisunique AS is_unique {_INDEXES.replace('WHERE', 'JOIN continuous_aggregates a ON a.materialization_hypertable_name = t.relname WHERE', 1)}"""))
def scan_aggregate_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scan_aggregate_indexes(relations(spark)).select("schema", "table", "name", "method", "is_unique")
