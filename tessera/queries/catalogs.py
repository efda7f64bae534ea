"""Catalog queries: differences, order, normal forms, and what scans of a catalog compute."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import normalize as N
from tessera.operators import diff as D
from tessera.operators import ordering
from tessera.plans import migrate
from tessera.queries.fixtures import current, desired
from tessera.queries.registry import query
from tessera.session import TABLES, table
from tessera.sources.catalog import KEYS, Catalog, extract_tables

_TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "boolean": "BOOLEAN"}


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def values_sql(rows: list[tuple], columns: list[tuple[str, str]]) -> str:
    """Rows as a typed SQL relation."""
    casts = ", ".join(f'CAST(x{i} AS {_TYPES[t]}) AS "{n}"' for i, (n, t) in enumerate(columns))
    if not rows:
        return f"(SELECT {', '.join(f'CAST(NULL AS {_TYPES[t]}) AS {chr(34)}{n}{chr(34)}' for n, t in columns)} WHERE FALSE)"
    body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"(SELECT {casts} FROM (VALUES {body}) v({', '.join(f'x{i}' for i in range(len(columns)))}))"


def _flat_sql(catalog: Catalog, entity: str) -> str:
    return values_sql(D.flat_rows(catalog, entity), D.flat_schema(entity))


def diff_sql(entity: str) -> str:
    """The comparison of one kind in plain SQL: a full join, and a branch for each change."""
    kind = D.KINDS[entity]
    more = "".join(f", {D._text(sql, 'duckdb')} AS {n}" for n, sql in kind.derived)
    c, d = (f"SELECT *, TRUE AS here{more} FROM {_flat_sql(x, entity)} t" for x in (current(), desired()))
    if kind.inside_tables:
        both = f"(SELECT a.schema, a.name FROM {_flat_sql(current(), 'tables')} a JOIN {_flat_sql(desired(), 'tables')} b ON a.schema = b.schema AND a.name = b.name)"
        c, d = (f"{x} WHERE (t.schema, t.\"table\") IN {both}" for x in (c, d))
    if entity == "indexes":
        stays = " UNION ALL ".join(f"SELECT schema, name FROM {_flat_sql(desired(), k)} x" for k in ("tables", "materialized_views", "aggregates"))
        c = f'{c} WHERE (t.schema, t."table") IN ({stays})'
    on = " AND ".join(f'c."{k}" IS NOT DISTINCT FROM d."{k}"' for k in KEYS[entity])
    names = ("change_type", "severity", "object_type", "object_name", "table_name", "old_value", "new_value")
    out = []
    for when, change, severity, name, tab, old, new in D._branches(kind, "duckdb"):
        fields = ", ".join(f"CAST({v} AS VARCHAR) AS {n}" for n, v in zip(names, (change, severity, f"'{kind.object_type}'", name, tab, old, new)))
        out.append(f"SELECT {fields} FROM c FULL JOIN d ON {on} WHERE {when}".replace("c.table", 'c."table"').replace("d.table", 'd."table"'))
    return f"WITH c AS ({c}), d AS ({d}) " + " UNION ALL ".join(out)


def _diff_query(entity: str) -> None:
    @query(diff_sql(entity), f"diff_{entity}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return D.diff_kind(spark, current(), desired(), entity)


for _entity in D.KINDS:
    _diff_query(_entity)

_ALL_SQL = " UNION ALL ".join(f"SELECT * FROM ({diff_sql(e)}) x_{e}" for e in D.KINDS)


@query(_ALL_SQL)
def diff_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.diff(spark, current(), desired())


@query(f"SELECT change_type, count(*) AS n FROM ({_ALL_SQL}) a GROUP BY 1")
def diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.stats(D.diff(spark, current(), desired()))


@query(f"SELECT count(*) FILTER (WHERE severity = 'SAFE') AS safe, count(*) FILTER (WHERE severity = 'POTENTIALLY_BREAKING') AS potentially_breaking, count(*) FILTER (WHERE severity = 'DATA_MIGRATION_REQUIRED') AS data_migration_required, count(*) FILTER (WHERE severity = 'BREAKING') AS breaking FROM ({_ALL_SQL}) a")
def diff_severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.severity_summary(D.diff(spark, current(), desired()))


@query(f"SELECT * FROM ({_ALL_SQL}) a WHERE severity = 'BREAKING'")
def diff_breaking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.diff(spark, current(), desired()).filter(F.col("severity") == D.BREAKING)


@query()
def dependency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(waits, waits_for) by names of changes; the rules' joins have no counterpart in SQL over the fixture."""
    changes = migrate.all_changes(spark, current(), desired())
    frame = spark.createDataFrame(migrate.nodes_of(changes, current(), desired()), ordering.NODES).coalesce(1)
    label = frame.select("id", F.concat_ws(" ", "change_type", "object_name").alias("label"))
    found = ordering.edges(frame)
    return found.join(label.select(F.col("id").alias("waits"), F.col("label").alias("change")), "waits").join(label.select(F.col("id").alias("waits_for"), F.col("label").alias("after")), "waits_for").select("change", "after")


_GRAPH = [(1, 0), (2, 0), (3, 1), (3, 2), (4, 3), (5, 4), (6, 0), (7, 6), (7, 4), (9, 8)]
_GRAPH_SQL = values_sql(_GRAPH, [("waits", "bigint"), ("waits_for", "bigint")])


@query(f"""WITH RECURSIVE e AS (SELECT * FROM {_GRAPH_SQL} t), ids AS (SELECT unnest(range(11)) AS id),
             chain(id, level) AS (SELECT id, 0 FROM ids WHERE id NOT IN (SELECT waits FROM e) UNION ALL SELECT e.waits, c.level + 1 FROM chain c JOIN e ON e.waits_for = c.id)
           SELECT id, max(level) AS level FROM chain GROUP BY 1""")
def dependency_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.levels(spark, spark.range(11), spark.createDataFrame(_GRAPH, "waits bigint, waits_for bigint"))


@query()
def migration_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, _ = migrate.generate(spark, current(), desired())
    return spark.createDataFrame([(f.name, f.content) for f in files], "name string, content string")


@query()
def migration_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes of each file in order."""
    rows = [(version, place, c.change_type, c.object_name) for version, _, several in migrate.numbered(spark, current(), desired()) for place, c in enumerate(several)]
    return spark.createDataFrame(rows, "version int, place int, change_type string, object_name string")


@query()
def migration_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = migrate.numbered(spark, current(), desired())
    return spark.createDataFrame([(v, migrate.file_name(v, name, "up"), len(several)) for v, name, several in files], "version int, name string, changes int")


@query(" UNION ALL ".join(f"SELECT '{e}' AS entity, count(*) AS n FROM {_flat_sql(desired(), e)} t" for e in D.KINDS))
def catalog_entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = desired().counts()
    return spark.createDataFrame([(e, counts[e]) for e in D.KINDS], "entity string, n bigint")


# ---- normal forms

_SAMPLES = {
    "type": ["INT", "int4", "varchar(50)", "character varying(255)", "DECIMAL(10, 2)", "timestamptz", "timestamp", "TIMESTAMP WITH TIME ZONE", "bool", "float8", "text[]", "int[]", "  double   precision ", "character(3)", "vector(3)", "time", "bigserial", "uuid"],
    "default": ["now()", "CURRENT_TIMESTAMP", "'a'::text", "true", "FALSE", "'t'", "0", "'{}'::jsonb", "nextval('s'::regclass)", "clock_timestamp()", "'x'::character varying(20)", "ARRAY[]::text[]"],
    "interval": ["1 hour", "01:00:00", "60 minutes", "90 sec", "2 Days", "1 week", "3 months", "1 day", "12 hours", "5 years"],
    "comment": ["a  b", " x ", "line\nbreak", "", "two\r\nlines  here", "plain"],
    "identifier": ['"Users"', " Name ", "a" * 70, "plain"],
    "action": ["", "cascade", " set null ", "NO ACTION", "Restrict"],
    "check_option": ["", "none", "local", "CASCADED"],
    "body": ["BEGIN\n  RETURN  NEW;\nEND", "", "select 1"],
}
_NORMAL = {"type": N.type_sql, "default": N.default_sql, "interval": N.interval_sql, "comment": N.comment_sql, "identifier": N.identifier_sql, "action": N.action_sql, "check_option": N.check_option_sql, "body": N.body_sql}


def _normal_query(kind: str) -> None:
    rows = [(x,) for x in _SAMPLES[kind]]

    @query(f"SELECT given, {_NORMAL[kind]('given', 'duckdb')} AS normal FROM {values_sql(rows, [('given', 'string')])} t", f"{kind}_normalize")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.createDataFrame(rows, "given string").select("given", F.expr(_NORMAL[kind]("given")).alias("normal"))


for _kind in _SAMPLES:
    _normal_query(_kind)

_CHANGES = [("smallint", "integer"), ("smallint", "bigint"), ("integer", "bigint"), ("bigint", "integer"), ("varchar(10)", "varchar(20)"), ("varchar(20)", "varchar(10)"), ("char(5)", "char(9)"), ("numeric(10,2)", "numeric(12,2)"), ("numeric(10,2)", "numeric(12,1)"), ("numeric(10)", "numeric(12,2)"), ("varchar(10)", "text"), ("text", "varchar(10)"), ("integer", "text"), ("char(3)", "varchar(9)")]


@query(f"SELECT old, new, {N.widens_sql('old', 'new', 'duckdb')} AS safe FROM {values_sql(_CHANGES, [('old', 'string'), ('new', 'string')])} t")
def type_safe_widening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_CHANGES, "old string, new string").select("old", "new", F.expr(N.widens_sql("old", "new")).alias("safe"))


_VIEWS = [("v1", "SELECT a FROM public.t JOIN s.u ON t.id = u.id"), ("v2", "SELECT 1 FROM t LEFT JOIN app.w USING (id) WHERE x IN (SELECT y FROM z)"), ("v3", "SELECT count(*) FROM events")]
_PATTERN = r"(?i)\b(?:FROM|JOIN)\s+([a-z_][a-z0-9_.]*)"


@query(f"SELECT DISTINCT name, CASE WHEN contains(source, '.') THEN source ELSE 'public.' || source END AS source FROM (SELECT name, unnest(regexp_extract_all(definition, '{_PATTERN}', 1)) AS source FROM {values_sql(_VIEWS, [('name', 'string'), ('definition', 'string')])} t)")
def view_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = spark.createDataFrame(_VIEWS, "name string, definition string")
    found = views.select("name", F.explode(F.regexp_extract_all("definition", F.lit(_PATTERN), 1)).alias("source"))
    return found.select("name", F.when(F.contains("source", F.lit(".")), F.col("source")).otherwise(F.concat(F.lit("public."), "source")).alias("source")).distinct()


# ---- what catalog scans compute


@query(
    """SELECT table_name AS "table", column_name AS name, ordinal_position::INTEGER AS position,
       CASE data_type WHEN 'VARCHAR' THEN 'text' WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'integer' WHEN 'DOUBLE' THEN 'double precision' WHEN 'TIMESTAMP' THEN 'timestamp without time zone' ELSE lower(data_type) END AS type
       FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events')"""
)
def extract_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_tables({t: table(spark, sf_dir, t) for t in TABLES}).frame(spark, "columns").select("table", "name", "position", "type")


@query(" UNION ALL ".join(f"SELECT '{t}' AS entity, count(*) AS n FROM {t}" for t in TABLES))
def extract_entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [table(spark, sf_dir, t).agg(F.lit(t).alias("entity"), F.count("*").alias("n")) for t in TABLES]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS members, list(n_name ORDER BY n_nationkey) FILTER (WHERE n_nationkey % 2 = 0) AS even FROM nation GROUP BY 1")
def partition_members_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    member = F.struct("n_nationkey", "n_name")
    lists = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(member)).alias("all"), F.array_sort(F.collect_list(F.when(F.col("n_nationkey") % 2 == 0, member))).alias("some"))
    return lists.select("n_regionkey", F.col("all.n_name").alias("members"), F.when(F.size("some") > 0, F.col("some.n_name")).alias("even"))


@query("SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_nationkey) FILTER (WHERE n_nationkey > 5) AS listed FROM nation GROUP BY 1")
def compression_settings_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT n_regionkey, listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_nationkey) FILTER (WHERE n_nationkey > 5) AS listed FROM {n} GROUP BY 1", n=table(spark, sf_dir, "nation"))


@query("""SELECT p_partkey, list_filter([CASE WHEN p_size & 4 <> 0 THEN 'INSERT' END, CASE WHEN p_size & 8 <> 0 THEN 'DELETE' END, CASE WHEN p_size & 16 <> 0 THEN 'UPDATE' END], lambda x: x IS NOT NULL) AS events,
                 CASE WHEN p_size & 2 <> 0 THEN 'BEFORE' ELSE 'AFTER' END AS timing FROM part""")
def trigger_bits_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    bit = lambda n: F.col("p_size").bitwiseAND(n) != 0
    events = F.array_compact(F.array(F.when(bit(4), "INSERT"), F.when(bit(8), "DELETE"), F.when(bit(16), "UPDATE")))
    return table(spark, sf_dir, "part").select("p_partkey", events.alias("events"), F.when(bit(2), "BEFORE").otherwise("AFTER").alias("timing"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k, json_extract_string(props, '$.none') AS none FROM events")
def policy_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.none").alias("none"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def last_definition_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = W.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    return table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(place)).filter("n = 1").select("o_custkey", "o_orderkey", "o_totalprice")


_SEEN = [("a", "x,y"), ("b", "y,x"), ("c", "X,Y"), ("d", "x")]


@query(f"SELECT l.name AS a, r.name AS b, list_sort(string_split(lower(l.cols), ',')) = list_sort(string_split(lower(r.cols), ',')) AS same_set, l.cols = r.cols AS same_list FROM {values_sql(_SEEN, [('name', 'string'), ('cols', 'string')])} l JOIN {values_sql(_SEEN, [('name', 'string'), ('cols', 'string')])} r ON l.name < r.name")
def column_set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of columns compared as sets and as lists."""
    seen = spark.createDataFrame(_SEEN, "name string, cols string")
    as_set = lambda c: F.array_sort(F.split(F.lower(c), ","))
    joined = seen.alias("l").join(seen.alias("r"), F.expr("l.name < r.name"))
    return joined.select(F.col("l.name").alias("a"), F.col("r.name").alias("b"), (as_set(F.col("l.cols")) == as_set(F.col("r.cols"))).alias("same_set"), (F.col("l.cols") == F.col("r.cols")).alias("same_list"))
