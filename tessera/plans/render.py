"""DDL text of changes, forwards and back. A change back is the opposite change between the catalogs exchanged."""

from __future__ import annotations

import re
from typing import Any, NamedTuple

from tessera.sources.catalog import Catalog

Row = dict[str, Any]
_PLAIN = re.compile(r"[a-z_][a-z0-9_$]*")
#: Words that need quotes as names.
_RESERVED = frozenset("all and any array as asc both case cast check collate column constraint create default desc distinct do else end except false for foreign from grant group having in initially intersect into leading limit not null offset on only or order primary references returning select some table then to trailing true union unique user using when where window with".split())


class Change(NamedTuple):
    change_type: str
    severity: str
    object_type: str
    object_name: str
    table_name: str | None
    old_value: str | None
    new_value: str | None


class Statement(NamedTuple):
    sql: str
    unsafe: bool
    note: str


class CannotRender(ValueError):
    """There is no statement for a change."""


def quote(name: str) -> str:
    return name if _PLAIN.fullmatch(name) and name not in _RESERVED else '"' + name.replace('"', '""') + '"'


def qualified(name: str) -> str:
    return ".".join(quote(p) for p in name.split("."))


def literal(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _own(row: Row) -> str:
    return f"{quote(row['schema'])}.{quote(row.get('name') or row['table'])}"


def column_sql(row: Row) -> str:
    parts = [quote(row["name"]), row["type"].upper()]
    if row["generated"]:
        parts.append(f"GENERATED ALWAYS AS ({row['generated']}) STORED")
    elif row["identity"] is not None:
        parts.append(f"GENERATED {row['identity']} AS IDENTITY")
    elif (row["default"] or "").startswith("nextval(") and row["type"] in ("integer", "bigint", "smallint"):
        return f"{quote(row['name'])} " + {"integer": "SERIAL", "bigint": "BIGSERIAL", "smallint": "SMALLSERIAL"}[row["type"]]
    elif row["default"] is not None:
        parts.append(f"DEFAULT {row['default']}")
    return " ".join(parts + ([] if row["nullable"] else ["NOT NULL"]))


def constraint_sql(row: Row) -> str:
    names = ", ".join(quote(c) for c in row["columns"] or [])
    body = {"PRIMARY KEY": f"PRIMARY KEY ({names})", "UNIQUE": f"UNIQUE ({names})", "CHECK": f"CHECK ({row['expression']})", "EXCLUDE": f"EXCLUDE {row['expression']}"}.get(row["kind"])
    if body is None:
        body = f"FOREIGN KEY ({names}) REFERENCES {qualified(row['ref_table'])}" + (f" ({', '.join(quote(c) for c in row['ref_columns'])})" if row["ref_columns"] else "")
        body += "".join(f" ON {w} {row[k]}" for w, k in (("DELETE", "on_delete"), ("UPDATE", "on_update")) if row[k] and row[k] != "NO ACTION")
    if row["deferrable"]:
        body += " DEFERRABLE" + (" INITIALLY DEFERRED" if row["initially_deferred"] else "")
    return f"CONSTRAINT {quote(row['name'])} {body}"


def index_sql(row: Row, guard: bool) -> str:
    sql = f"CREATE {'UNIQUE ' if row['is_unique'] else ''}INDEX {'IF NOT EXISTS ' if guard else ''}{quote(row['name'])} ON {quote(row['schema'])}.{quote(row['table'])} USING {row['method']} ({', '.join(row['columns'])})"
    sql += f" INCLUDE ({', '.join(map(quote, row['include']))})" if row["include"] else ""
    sql += " NULLS NOT DISTINCT" if row["nulls_not_distinct"] else ""
    sql += f" WITH ({', '.join(f'{k} = {v}' for k, v in sorted(row['params'].items()))})" if row["params"] else ""
    return sql + (f" WHERE {row['predicate']}" if row["predicate"] else "") + ";"


def table_sql(row: Row, catalog: Catalog, guard: bool) -> str:
    mine = lambda kind: [r for r in catalog.sorted_rows(kind) if (r["schema"], r["table"]) == (row["schema"], row["name"])]
    rank = {"PRIMARY KEY": 0, "FOREIGN KEY": 1, "UNIQUE": 2, "CHECK": 3, "EXCLUDE": 4}
    parts = [column_sql(c) for c in mine("columns")] + [constraint_sql(c) for c in sorted(mine("constraints"), key=lambda c: (rank[c["kind"]], c["name"]))]
    by = f" PARTITION BY {row['partition_type']} ({', '.join(row['partition_columns'])})" if row["partition_type"] else ""
    return f"CREATE TABLE {'IF NOT EXISTS ' if guard else ''}{_own(row)} (\n    " + ",\n    ".join(parts) + f"\n){by};"


def aggregate_sql(row: Row, catalog: Catalog, guard: bool) -> str:
    sql = f"CREATE MATERIALIZED VIEW {'IF NOT EXISTS ' if guard else ''}{_own(row)}\nWITH (timescaledb.continuous) AS\n{row['definition']}\nWITH {'' if row['with_data'] else 'NO '}DATA;"
    return "\n".join([sql, *(index_sql(i, guard) for i in catalog.sorted_rows("indexes") if (i["schema"], i["table"]) == (row["schema"], row["name"]))])


def compression_sql(row: Row) -> str:
    name = f"{row['schema']}.{row['table']}"
    options = ["timescaledb.compress"] + [f"timescaledb.compress_{k} = '{', '.join(row[c])}'" for k, c in (("segmentby", "segment_by"), ("orderby", "order_by")) if row[c]]
    sql = f"ALTER TABLE {qualified(name)} SET ({', '.join(options)});"
    return sql + (f"\nSELECT add_compression_policy('{name}', INTERVAL '{row['compress_after']}');" if row["compress_after"] else "")


def function_sql(row: Row) -> str:
    flags = [row["volatility"], *(["STRICT"] if row["strict"] else []), *(["SECURITY DEFINER"] if row["security_definer"] else [])]
    tag = "$$" if "$$" not in (row["body"] or "") else "$body$"
    return f"CREATE OR REPLACE FUNCTION {_own(row)}({row['args']}) RETURNS {row['returns']}\nLANGUAGE {row['language']} {' '.join(flags)} AS {tag}{row['body']}{tag};"


def trigger_sql(row: Row) -> str:
    events = " OR ".join("UPDATE OF " + ", ".join(row["update_columns"]) if e == "UPDATE" and row["update_columns"] else e for e in row["events"])
    when = f" WHEN ({row['condition']})" if row["condition"] else ""
    return f"CREATE TRIGGER {quote(row['name'])} {row['timing']} {events} ON {quote(row['schema'])}.{quote(row['table'])} FOR EACH {'ROW' if row['per_row'] else 'STATEMENT'}{when} EXECUTE FUNCTION {qualified(row['function'])}();"


def sequence_sql(row: Row, verb: str = "CREATE") -> str:
    parts = [f"INCREMENT BY {row['increment']}", f"MINVALUE {row['min_value']}" if row["min_value"] is not None else "NO MINVALUE", f"MAXVALUE {row['max_value']}" if row["max_value"] is not None else "NO MAXVALUE", "CYCLE" if row["cycle"] else "NO CYCLE", *([f"START WITH {row['start']}"] if row["start"] is not None else []), *([f"CACHE {row['cache']}"] if row["cache"] is not None else [])]
    return f"{verb} SEQUENCE {_own(row)} {' '.join(parts)};"


def type_sql(row: Row) -> str:
    if row["kind"] == "domain":
        return f"CREATE DOMAIN {_own(row)} AS {row['definition']};"
    return f"CREATE TYPE {_own(row)} AS ENUM ({', '.join(map(literal, row['labels']))});" if row["kind"] == "enum" else f"CREATE TYPE {_own(row)} AS {row['definition']};"


def comment_sql(noun: str, row: Row) -> str:
    """The comment on a type, a domain or an extension."""
    what = f"EXTENSION {quote(row['name'])}" if noun == "EXTENSION" else f"{'DOMAIN' if row['kind'] == 'domain' else 'TYPE'} {_own(row)}"
    return f"COMMENT ON {what} IS {literal(row['comment'])};"


def _hypertable_sql(row: Row) -> str:
    space = f", partitioning_column => {literal(row['space_column'])}, number_partitions => {row['space_partitions']}" if row["space_column"] else ""
    return f"SELECT create_hypertable('{row['schema']}.{row['table']}', {literal(row['time_column'])}, chunk_time_interval => INTERVAL '{row['chunk_interval']}'{space});"


def _refresh_sql(row: Row) -> str:
    span = lambda v: f"INTERVAL '{v}'" if v else "NULL"
    return f"SELECT add_continuous_aggregate_policy('{row['schema']}.{row['name']}', start_offset => {span(row['start_offset'])}, end_offset => {span(row['end_offset'])}, schedule_interval => {span(row['schedule'])});"


#: Change noun to (entity kind, create, drop); both take (row, catalog, guard).
_OBJECTS = {
    "SCHEMA": ("schemas", lambda r, c, g: f"CREATE SCHEMA {_if(g, False)}{quote(r['name'])};", lambda r, c, g: f"DROP SCHEMA {_if(g, True)}{quote(r['name'])} CASCADE;"),
    "EXTENSION": ("extensions", lambda r, c, g: f"CREATE EXTENSION {_if(g, False)}{quote(r['name'])}" + (f" SCHEMA {quote(r['schema'])}" if r["schema"] else "") + (f" VERSION {literal(r['version'])}" if r["version"] else "") + ";", lambda r, c, g: f"DROP EXTENSION {_if(g, True)}{quote(r['name'])} CASCADE;"),
    "CUSTOM_TYPE": ("types", lambda r, c, g: type_sql(r), lambda r, c, g: f"DROP {'DOMAIN' if r['kind'] == 'domain' else 'TYPE'} {_if(g, True)}{_own(r)} CASCADE;"),
    "SEQUENCE": ("sequences", lambda r, c, g: sequence_sql(r), lambda r, c, g: f"DROP SEQUENCE {_if(g, True)}{_own(r)} CASCADE;"),
    "TABLE": ("tables", table_sql, lambda r, c, g: f"DROP TABLE {_if(g, True)}{_own(r)} CASCADE;"),
    "PARTITION": ("partitions", lambda r, c, g: f"CREATE TABLE {_if(g, False)}{_own(r)} PARTITION OF {qualified(r['parent'])} {r['bounds']};", lambda r, c, g: f"DROP TABLE {_if(g, True)}{_own(r)};"),
    "COLUMN": ("columns", lambda r, c, g: f"{_alter(r)} ADD COLUMN {_if(g, False)}{column_sql(r)};", lambda r, c, g: f"{_alter(r)} DROP COLUMN {_if(g, True)}{quote(r['name'])} CASCADE;"),
    "CONSTRAINT": ("constraints", lambda r, c, g: f"{_alter(r)} ADD {constraint_sql(r)};", lambda r, c, g: f"{_alter(r)} DROP CONSTRAINT {_if(g, True)}{quote(r['name'])};"),
    "INDEX": ("indexes", lambda r, c, g: index_sql(r, g), lambda r, c, g: f"DROP INDEX {_if(g, True)}{_own(r)};"),
    "VIEW": ("views", lambda r, c, g: f"CREATE OR REPLACE VIEW {_own(r)} AS\n{r['definition']}" + (f"\nWITH {r['check_option']} CHECK OPTION" if r["check_option"] else "") + ";", lambda r, c, g: f"DROP VIEW {_if(g, True)}{_own(r)} CASCADE;"),
    "MATERIALIZED_VIEW": ("materialized_views", lambda r, c, g: f"CREATE MATERIALIZED VIEW {_if(g, False)}{_own(r)} AS\n{r['definition']}\nWITH {'' if r['with_data'] else 'NO '}DATA;", lambda r, c, g: f"DROP MATERIALIZED VIEW {_if(g, True)}{_own(r)} CASCADE;"),
    "FUNCTION": ("functions", lambda r, c, g: function_sql(r), lambda r, c, g: f"DROP FUNCTION {_if(g, True)}{_own(r)}({r['arg_types']}) CASCADE;"),
    "TRIGGER": ("triggers", lambda r, c, g: trigger_sql(r), lambda r, c, g: f"DROP TRIGGER {_if(g, True)}{quote(r['name'])} ON {quote(r['schema'])}.{quote(r['table'])};"),
    "HYPERTABLE": ("hypertables", lambda r, c, g: _hypertable_sql(r), lambda r, c, g: f"-- {r['schema']}.{r['table']} stays a time-partitioned table: move its rows to a plain table by hand"),
    "COMPRESSION_POLICY": ("compression", lambda r, c, g: compression_sql(r), lambda r, c, g: f"SELECT remove_compression_policy('{r['schema']}.{r['table']}', if_exists => true);"),
    "RETENTION_POLICY": ("retention", lambda r, c, g: f"SELECT add_retention_policy('{r['schema']}.{r['table']}', INTERVAL '{r['drop_after']}');", lambda r, c, g: f"SELECT remove_retention_policy('{r['schema']}.{r['table']}', if_exists => true);"),
    "CONTINUOUS_AGGREGATE": ("aggregates", aggregate_sql, lambda r, c, g: f"DROP MATERIALIZED VIEW {_if(g, True)}{_own(r)} CASCADE;"),
    "REFRESH_POLICY": ("refreshes", lambda r, c, g: _refresh_sql(r), lambda r, c, g: f"SELECT remove_continuous_aggregate_policy('{r['schema']}.{r['name']}', if_exists => true);"),
}


def _if(guard: bool, drop: bool) -> str:
    return ("IF EXISTS " if drop else "IF NOT EXISTS ") if guard else ""


def _alter(r: Row) -> str:
    return f"ALTER TABLE {quote(r['schema'])}.{quote(r['table'])}"


def find(catalog: Catalog, noun: str, name: str) -> Row:
    kind = _OBJECTS[noun][0]
    for r in catalog.rows[kind]:
        own = ".".join(str(r[k]) for k in ("schema", "table", "name") if k in r and r[k] is not None) if kind not in ("schemas", "extensions", "indexes") else f"{r['schema']}.{r['name']}" if kind == "indexes" else r["name"]
        if kind == "functions":
            own += f"({r['arg_types']})"
        if own == name:
            return r
    raise CannotRender(f"{noun} {name} isn't in the catalog")


#: Changes of a table that can't be made while its chunks are compressed.
_UNCOMPRESSED = ("ADD_COLUMN", "DROP_COLUMN", "MODIFY_COLUMN_DEFAULT", "MODIFY_COLUMN_TYPE", "MODIFY_COLUMN_NULLABILITY", "MODIFY_COLUMN_IDENTITY", "MODIFY_COLUMN_GENERATED", "ADD_CONSTRAINT", "DROP_CONSTRAINT", "MODIFY_CONSTRAINT")


def _compression(catalog: Catalog, table: str | None) -> Row | None:
    return next((r for r in catalog.rows["compression"] if f"{r['schema']}.{r['table']}" == table), None)


def uncompressed(statement: Statement, table: str, stays: Row | None) -> Statement:
    """A statement between taking a table's compression off and putting it on again, with the settings that are to be; chunks
    that are compressed already are left to the one who runs it, as that may take long."""
    name = qualified(table)
    by_hand = f"SELECT decompress_chunk(c, true) FROM show_chunks('{table}') c;"
    parts = [f"-- chunks of {table} that are compressed have to be decompressed first, which may take long:", f"--   {by_hand}", f"ALTER TABLE {name} SET (timescaledb.compress = false);", statement.sql]
    return Statement("\n".join(parts + ([compression_sql(stays | {"compress_after": None})] if stays else [])), True, statement.note)


def up(change: Change, current: Catalog, desired: Catalog, guard: bool = True) -> Statement:
    """The statement that makes a change; where the table is compressed, compression is off meanwhile."""
    statement = _up(change, current, desired, guard)
    if change.change_type in _UNCOMPRESSED and _compression(current, change.table_name):
        return uncompressed(statement, change.table_name, _compression(desired, change.table_name))
    return statement


def _up(change: Change, current: Catalog, desired: Catalog, guard: bool) -> Statement:
    verb, _, noun = change.change_type.partition("_")
    unsafe = change.severity != "SAFE"
    if verb in ("ADD", "DROP"):
        catalog = desired if verb == "ADD" else current
        row = find(catalog, noun, change.object_name)
        sql = _OBJECTS[noun][1 if verb == "ADD" else 2](row, catalog, guard)
        comments = [f"COMMENT ON {noun.replace('_', ' ')} {_own(row)} IS {literal(row['comment'])};"] if verb == "ADD" and noun in ("TABLE", "VIEW", "MATERIALIZED_VIEW") and row.get("comment") else []
        if verb == "ADD" and noun in ("CUSTOM_TYPE", "EXTENSION") and row.get("comment"):
            comments.append(comment_sql(noun, row))
        if verb == "ADD" and noun == "TABLE":
            comments += [f"COMMENT ON COLUMN {_own(row)}.{quote(c['name'])} IS {literal(c['comment'])};" for c in catalog.sorted_rows("columns") if (c["schema"], c["table"]) == (row["schema"], row["name"]) and c["comment"]]
        return Statement("\n".join([sql, *comments]), unsafe, f"{verb.lower()} {change.object_type} {change.object_name}")
    return Statement(_modify(change, noun, current, desired, guard), unsafe, f"modify {change.object_type} {change.object_name}")


def _modify(change: Change, noun: str, current: Catalog, desired: Catalog, guard: bool) -> str:
    if noun.startswith("COLUMN_"):
        old, new = find(current, "COLUMN", change.object_name), find(desired, "COLUMN", change.object_name)
        name, table = quote(new["name"]), _alter(new)
        if noun == "COLUMN_TYPE":
            return f"{table} ALTER COLUMN {name} TYPE {new['type'].upper()} USING {name}::{new['type']};"
        if noun == "COLUMN_NULLABILITY":
            return f"{table} ALTER COLUMN {name} {'DROP' if new['nullable'] else 'SET'} NOT NULL;"
        if noun == "COLUMN_DEFAULT":
            return f"{table} ALTER COLUMN {name} " + (f"SET DEFAULT {new['default']};" if new["default"] is not None else "DROP DEFAULT;")
        if noun == "COLUMN_IDENTITY":
            if old["identity"] and new["identity"]:
                return f"{table} ALTER COLUMN {name} SET GENERATED {new['identity']};"
            return f"{table} ALTER COLUMN {name} " + (f"ADD GENERATED {new['identity']} AS IDENTITY;" if new["identity"] else f"DROP IDENTITY{' IF EXISTS' if guard else ''};")
        if noun == "COLUMN_GENERATED":
            if new["generated"] is None:
                return f"{table} ALTER COLUMN {name} DROP EXPRESSION{' IF EXISTS' if guard else ''};"
            return f"{table} DROP COLUMN {_if(guard, True)}{name} CASCADE;\n{table} ADD COLUMN {column_sql(new)};"
        return f"COMMENT ON COLUMN {quote(old['schema'])}.{quote(old['table'])}.{name} IS {literal(new['comment'])};"
    if noun == "TABLE_COMMENT":
        return f"COMMENT ON TABLE {_own(r := find(desired, 'TABLE', change.object_name))} IS {literal(r['comment'])};"
    if noun == "TABLE_PARTITIONING":
        raise CannotRender(f"the rows of {change.object_name} have to be moved to a new table by hand")
    kind, create, drop = _OBJECTS[noun.removesuffix("_COMMENT")]
    old, new = (find(c, noun.removesuffix("_COMMENT"), change.object_name) for c in (current, desired))
    if noun in ("VIEW", "MATERIALIZED_VIEW", "FUNCTION") and change.old_value != old.get("definition") and old.get("comment") != new.get("comment") and change.severity == "SAFE":
        what = f"{_own(new)}({new['arg_types']})" if noun == "FUNCTION" else _own(new)
        return f"COMMENT ON {noun.replace('_', ' ')} {what} IS {literal(new['comment'])};"
    if noun in ("CUSTOM_TYPE_COMMENT", "EXTENSION_COMMENT"):
        return comment_sql(noun.removesuffix("_COMMENT"), new)
    if noun == "EXTENSION":
        parts = [f"ALTER EXTENSION {quote(new['name'])} SET SCHEMA {quote(new['schema'])};"] if new["schema"] and new["schema"] != old["schema"] else []
        return "\n".join(parts + ([f"ALTER EXTENSION {quote(new['name'])} UPDATE TO {literal(new['version'])};"] if new["version"] and new["version"] != old["version"] else [])) or f"-- nothing to alter in extension {new['name']}"
    if noun == "CUSTOM_TYPE" and new["kind"] == "enum":
        if gone := [v for v in old["labels"] if v not in new["labels"]]:
            raise CannotRender(f"values {', '.join(gone)} can't be taken out of enum {change.object_name}")
        added, out = [v for v in new["labels"] if v not in old["labels"]], []
        for v in added:
            at = new["labels"].index(v)
            out.append(f"ALTER TYPE {_own(new)} ADD VALUE {_if(guard, False)}{literal(v)}" + (f" AFTER {literal(new['labels'][at - 1])};" if at else f" BEFORE {literal(new['labels'][1])};"))
        return "\n".join(out)
    if noun == "SEQUENCE":
        return sequence_sql(new, "ALTER")
    if noun == "VIEW" or noun == "FUNCTION" and old["returns"] == new["returns"]:
        return create(new, desired, guard)
    if noun == "HYPERTABLE" and old["time_column"] == new["time_column"]:
        if old["space_column"] != new["space_column"]:
            raise CannotRender(f"the space column of {change.object_name} can't be changed in place")
        if old["space_partitions"] != new["space_partitions"]:
            name = f"'{new['schema']}.{new['table']}'"
            return f"SELECT set_number_partitions({name}, {new['space_partitions']});\nSELECT set_chunk_time_interval({name}, INTERVAL '{new['chunk_interval']}');"
        return f"SELECT set_chunk_time_interval('{new['schema']}.{new['table']}', INTERVAL '{new['chunk_interval']}');"
    return f"{drop(old, current, guard)}\n{create(new, desired, guard)}"


def down(change: Change, current: Catalog, desired: Catalog, guard: bool = True) -> Statement:
    """The statement that takes a change back; a comment for the one who does it by hand where there is none."""
    verb, _, noun = change.change_type.partition("_")
    back = change._replace(change_type=f"{ {'ADD': 'DROP', 'DROP': 'ADD'}.get(verb, verb) }_{noun}", old_value=change.new_value, new_value=change.old_value)
    try:
        return up(back, desired, current, guard)
    except CannotRender as e:
        return Statement(f"-- to be taken back by hand: {change.change_type} {change.object_name} ({e})", True, "manual")
