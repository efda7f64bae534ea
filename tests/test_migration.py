"""Migrations of compressed tables, of comments, and of what goes with its table."""

from __future__ import annotations

import os

from tessera.operators import diff as D
from tessera.plans import migrate
from tessera.plans.render import down, up
from tessera.sources.catalog import read_folders
from tessera.sources.ddl import parse

PLAIN = "CREATE TABLE m (at timestamptz NOT NULL, v integer, w integer); SELECT create_hypertable('m', 'at');"
ON = " ALTER TABLE m SET (timescaledb.compress, timescaledb.compress_segmentby = 'w', timescaledb.compress_orderby = 'at desc'); SELECT add_compression_policy('m', INTERVAL '7 days');"


def changes(spark, c, d):
    return {x.change_type: x for x in migrate.all_changes(spark, c, d)}


def test_compression_is_off_while_a_column_changes(spark):
    c, d = parse(PLAIN + ON), parse((PLAIN + ON).replace("v integer", "v bigint"))
    change = changes(spark, c, d)["MODIFY_COLUMN_TYPE"]
    for statement, kind in ((up(change, c, d), "BIGINT"), (down(change, c, d), "INTEGER")):
        lines = statement.sql.split("\n")
        assert statement.unsafe and "decompress_chunk" in statement.sql
        off, alter, on = (next(i for i, x in enumerate(lines) if y in x) for y in ("compress = false", f"TYPE {kind}", "compress_segmentby"))
        assert off < alter < on and "compress_orderby" in lines[on] and "add_compression_policy" not in statement.sql


def test_compression_stays_off_where_it_is_dropped_and_plain_tables_know_none(spark):
    c, d = parse(PLAIN + ON), parse(PLAIN.replace("v integer", "v bigint"))
    assert "compress_segmentby" not in up(changes(spark, c, d)["MODIFY_COLUMN_TYPE"], c, d).sql
    c = parse(PLAIN)
    assert "compress" not in up(changes(spark, c, d)["MODIFY_COLUMN_TYPE"], c, d).sql


def test_comments_on_types_and_extensions(spark):
    made = "CREATE EXTENSION hstore; CREATE TYPE mood AS ENUM ('a'); CREATE DOMAIN pos AS integer; "
    c = parse(made)
    d = parse(made + "COMMENT ON TYPE mood IS 'it''s'; COMMENT ON DOMAIN pos IS 'p'; COMMENT ON EXTENSION hstore IS 'pairs'; COMMENT ON TYPE none IS 'x'")
    assert len(d.rows["warnings"]) == 1
    found = {x.object_name: x for x in migrate.all_changes(spark, c, d)}
    assert up(found["public.mood"], c, d).sql == "COMMENT ON TYPE public.mood IS 'it''s';"
    assert up(found["public.pos"], c, d).sql == "COMMENT ON DOMAIN public.pos IS 'p';"
    assert down(found["hstore"], c, d).sql == "COMMENT ON EXTENSION hstore IS NULL;"
    assert D.diff(spark, c, d, ignore_comments=True).count() == 0
    files, warnings = migrate.generate(spark, parse(""), d)
    assert not warnings and "COMMENT ON DOMAIN" in "".join(f.content for f in files)


def test_what_goes_with_its_table_has_no_statement(spark):
    files, warnings = migrate.generate(spark, parse(PLAIN + ON), parse(""))
    text = "".join(f.content for f in files if f.name.endswith("up.sql"))
    assert "DROP TABLE" in text and "remove_compression_policy" not in text and "by hand" not in text and not warnings


def test_fixed_folders(spark, tmp_path):
    for name in ("views/b.sql", "tables/sub/a.sql", "other/c.sql", "d.sql"):
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text(f"-- {name}")
    assert [text for _, text in read_folders(spark, str(tmp_path))] == ["-- tables/sub/a.sql", "-- views/b.sql"]


def test_files_are_those_of_the_batches(spark):
    from tessera.queries.fixtures import current, desired

    several = migrate.numbered(spark, current(), desired(), migrate.Options(max_changes=5))
    assert [v for v, _, _ in several] == list(range(1, len(several) + 1))
    assert sorted(c for _, _, b in several for c in b) == sorted(migrate.all_changes(spark, current(), desired()))


def test_a_batch_without_a_statement_takes_no_number(spark):
    c = parse("CREATE SCHEMA a; CREATE TYPE a.mood AS ENUM ('x', 'y'); CREATE TABLE a.t (v integer); CREATE SCHEMA b; CREATE TABLE b.t (v integer);")
    d = parse("CREATE SCHEMA a; CREATE TYPE a.mood AS ENUM ('x'); CREATE TABLE a.t (v bigint); CREATE SCHEMA b; CREATE TABLE b.t (v bigint);")
    options = migrate.Options(max_changes=1, start_version=7)
    files, warnings = migrate.generate(spark, c, d, options)
    several = migrate.numbered(spark, c, d, options)
    assert warnings and len(migrate.all_changes(spark, c, d)) == 3
    assert [migrate.file_name(v, n, "up") for v, n, _ in several] == [f.name for f in files if f.name.endswith(".up.sql")]
    assert [v for v, _, _ in several] == [7, 8]
