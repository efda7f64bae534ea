"""Scans over an information schema: DuckDB's, as DataFrames."""

from __future__ import annotations

import duckdb
import pytest

from tessera.sources.scans import SYSTEM_SCHEMAS, extract, scan_tables, scan_views


@pytest.fixture(scope="module")
def found(spark):
    con = duckdb.connect()
    con.execute("CREATE SCHEMA app; CREATE TABLE app.users (id BIGINT PRIMARY KEY, name VARCHAR NOT NULL DEFAULT 'x', amount DECIMAL(10, 2), UNIQUE (name, amount)); CREATE TABLE schema_migrations (v INTEGER)")
    con.execute("CREATE TABLE app.posts (id INTEGER, user_id BIGINT REFERENCES app.users (id), CHECK (id > 0)); CREATE VIEW app.v AS SELECT id FROM app.users")
    wanted = {
        "tables": "table_schema, table_name, table_type", "columns": "table_schema, table_name, column_name, ordinal_position, data_type, is_nullable, column_default, character_maximum_length, numeric_precision, numeric_scale",
        "table_constraints": "constraint_schema, constraint_name, table_schema, table_name, constraint_type, is_deferrable, initially_deferred", "key_column_usage": "constraint_schema, constraint_name, table_schema, table_name, column_name, ordinal_position",
        "referential_constraints": "constraint_schema, constraint_name, unique_constraint_schema, unique_constraint_name, delete_rule, update_rule", "schemata": "schema_name",
    }
    out = {}
    for view, columns in wanted.items():
        rows = con.execute(f"SELECT {columns} FROM information_schema.{view}").fetchall()
        out[view] = spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in rows], ", ".join(f"{c} string" for c in columns.split(", ")))
    out["check_constraints"] = spark.createDataFrame([], "constraint_schema string, constraint_name string, check_clause string")
    out["views"] = spark.createDataFrame([("app", "v", "SELECT id FROM app.users"), ("pg_catalog", "x", "")], "table_schema string, table_name string, view_definition string")
    return out


def test_extraction(found):
    c = extract(found)
    assert {(t["schema"], t["name"]) for t in c.rows["tables"]} == {("app", "users"), ("app", "posts")}
    assert not {s["name"] for s in c.rows["schemas"]} & set(SYSTEM_SCHEMAS)
    assert c.find("columns", table="users", name="amount")["type"] == "decimal(10,2)" and not c.find("columns", table="users", name="name")["nullable"]
    kinds = {(k["table"], k["kind"], tuple(k["columns"])) for k in c.rows["constraints"]}
    assert {("users", "PRIMARY KEY", ("id",)), ("users", "UNIQUE", ("name", "amount")), ("posts", "FOREIGN KEY", ("user_id",))} <= kinds
    assert [v["name"] for v in c.rows["views"]] == ["v"]


def test_partitions_aggregates_and_exclusions_go(spark, found):
    assert scan_tables(found, spark.createDataFrame([("app", "posts")], "schema string, name string")).count() == 1
    assert scan_tables(found, exclude=["app"]).count() == 0
    assert scan_views(found, spark.createDataFrame([("app", "v")], "schema string, name string")).count() == 0


def test_whole_server(spark):
    """What the standard views and the server's own relations give together, against what they were made from."""
    from tessera.queries.server import relations
    from tessera.sources import server as S

    def frame(columns, *rows):
        return spark.createDataFrame(list(rows), ", ".join(f"{c} string" for c in columns.split()))

    tables = frame("table_schema table_name table_type", *((s, t, "BASE TABLE") for s, t in (("app", "users"), ("app", "logs"), ("app", "logs_a"), ("public", "logs_b"), ("public", "metrics"))))
    columns = frame("table_schema table_name column_name ordinal_position data_type is_nullable column_default character_maximum_length numeric_precision numeric_scale", ("app", "users", "id", "1", "integer", "NO", None, None, None, None), ("app", "logs_a", "at", "1", "integer", "NO", None, None, None, None))
    key = "constraint_schema constraint_name "
    standard = {
        "tables": tables, "columns": columns, "schemata": frame("schema_name", ("app",)), "views": frame("table_schema table_name view_definition", ("public", "by_hour", "x"), ("app", "v", "SELECT 1")),
        "table_constraints": frame(key + "table_schema table_name constraint_type is_deferrable initially_deferred"), "key_column_usage": frame(key + "table_schema table_name column_name ordinal_position"),
        "referential_constraints": frame(key + "unique_constraint_schema unique_constraint_name delete_rule update_rule"), "check_constraints": frame(key + "check_clause"),
    }
    c = S.extract(standard, relations(spark))
    assert {t["name"] for t in c.rows["tables"]} == {"users", "logs", "metrics"} and [x["table"] for x in c.rows["columns"]] == ["users"]
    assert c.find("tables", name="logs")["partition_columns"] == ["kind", "at"]
    assert {p["parent"] for p in c.rows["partitions"]} == {"app.logs"}
    index = c.find("indexes", name="users_name_idx")
    assert index["columns"] == ["name DESC", "lower(name)"] and index["include"] == ["id"] and index["params"] == {"fillfactor": "70", "buffering": "auto"} and not index["nulls_not_distinct"]
    assert {i["name"] for i in c.rows["indexes"]} == {"users_name_idx", "metrics_u_idx", "mat_idx"} and c.find("indexes", name="mat_idx")["table"] == "by_hour"
    trigger = c.find("triggers", name="touch_it")
    assert "new.id > 0" in trigger["condition"] and trigger["update_columns"] == ["boss", "name"] and trigger["events"] == ["INSERT", "UPDATE"]
    assert c.find("types", name="mood")["labels"] == ["glad", "mad", "sad"] and not c.find("types", name="users")
    assert {s["name"] for s in c.rows["sequences"]} == {"ids"} and {v["name"] for v in c.rows["views"]} == {"v"}
    assert c.find("compression", table="metrics")["order_by"] == ["at desc", "id asc"] and c.find("retention", table="other")["drop_after"] == "30 days"
    assert c.find("constraints", name="boss_fk")["ref_columns"] == ["id", "name"] and c.find("constraints", name="apart")["kind"] == "EXCLUDE"
    assert type(c).from_json(c.to_json()).to_json() == c.to_json()


def test_statements_for_the_server():
    from tessera.sources import server as S

    for relation in (*S.RELATIONS, *S.TIME_RELATIONS):
        text = S.server_query(relation)
        assert text.startswith("SELECT (") and text.endswith(f".{relation}")
    assert "(partattrs)::int2[]::int[] AS partattrs" in S.server_query("pg_partitioned_table")
