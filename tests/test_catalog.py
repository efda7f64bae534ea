"""SQL text, normal forms, comparison, ordering and migrations."""

from __future__ import annotations

import pytest

from tessera.__main__ import main
from tessera.functions.canonical import canonical, sources
from tessera.operators import diff as D
from tessera.operators.ordering import CycleError, components, topological
from tessera.plans import migrate
from tessera.plans.render import Change, down, quote, type_sql, up
from tessera.queries.fixtures import CURRENT, current, desired
from tessera.sources.catalog import Catalog, extract_tables, read_directory, read_json, write_json
from tessera.sources.ddl import parse, parse_all
from tessera.sources.lexer import SqlError, classify, statements, tokenize


def test_tokens_keep_strings_bodies_and_comments_apart():
    kinds = [t.kind for t in tokenize("SELECT 'it''s', \"Q\" -- no\n /* nor ; this */ $f$ a;b $f$ 1.5 a::int % 3")]
    assert kinds == ["word", "string", "op", "quoted", "body", "number", "word", "op", "word", "op", "number"]
    assert len(statements("SELECT 1; SELECT ';'; DO $$ x; y $$;")) == 3
    with pytest.raises(SqlError):
        tokenize("SELECT 'open")


@pytest.mark.parametrize(
    ("sql", "kind"),
    [("CREATE UNIQUE INDEX i ON t (a)", "index"), ("CREATE OR REPLACE VIEW v AS SELECT 1", "view"), ("SELECT create_hypertable('t', 'ts')", "hypertable"), ("DO $$ $$", "do"), ("GRANT ALL ON t TO u", "unknown"), ("CREATE CONSTRAINT TRIGGER t", "trigger")],
)
def test_statements_are_classified(sql, kind):
    assert classify(tokenize(sql)) == kind


def test_table_with_everything():
    c = parse("""CREATE TABLE IF NOT EXISTS s.t (id serial PRIMARY KEY, "Odd Name" numeric(10, 2)[] DEFAULT '{}'::numeric[], a int NOT NULL DEFAULT 1 CHECK (a > 0), b text UNIQUE,
        r bigint REFERENCES u (id) ON DELETE SET NULL DEFERRABLE INITIALLY DEFERRED, g int GENERATED ALWAYS AS (a * 2) STORED, k bigint GENERATED BY DEFAULT AS IDENTITY,
        at timestamp(3) with time zone, CONSTRAINT pair UNIQUE (a, b), EXCLUDE USING gist (r WITH &&))""")
    columns = {r["name"]: r for r in c.rows["columns"]}
    assert columns["id"]["type"] == "integer" and columns["id"]["default"] == "nextval('t_id_seq'::regclass)" and not columns["id"]["nullable"]
    assert columns["Odd Name"]["type"] == "numeric(10,2)[]" and columns["at"]["type"] == "timestamp(3) with time zone"
    assert columns["g"]["generated"] == "a * 2" and columns["k"]["identity"] == "BY DEFAULT"
    names = {r["name"]: r for r in c.rows["constraints"]}
    assert set(names) == {"t_pkey", "t_a_check", "t_b_key", "t_r_fkey", "pair", "t_excl"}
    assert names["t_r_fkey"]["on_delete"] == "SET NULL" and names["t_r_fkey"]["initially_deferred"]


def test_partitions_may_come_first_and_must_be_whole():
    catalog, errors = parse_all([("a.sql", "CREATE TABLE p0 PARTITION OF p FOR VALUES WITH (MODULUS 3, REMAINDER 0); CREATE TABLE d PARTITION OF q DEFAULT"), ("b.sql", "CREATE TABLE p (id int) PARTITION BY HASH (id)"), ("c.sql", "CREATE TABLE (")])
    assert catalog.rows["tables"][0]["partition_type"] == "HASH"
    assert any("remainders 1, 2 of 3" in e for e in errors) and any("no table public.q" in e for e in errors) and any(e.startswith("c.sql: line 1") for e in errors)


def test_policies_take_positions_and_names():
    c = parse("SELECT create_hypertable('s.t', by_range('ts', INTERVAL '1 day'), by_hash('dev', 4)); SELECT add_retention_policy('s.t', drop_after => INTERVAL '1 year'); SELECT add_continuous_aggregate_policy('v', NULL, INTERVAL '1 hour', INTERVAL '5 min');")
    assert c.rows["hypertables"][0] == {"schema": "s", "table": "t", "time_column": "ts", "chunk_interval": "1 day", "space_column": "dev", "space_partitions": 4}
    assert c.rows["retention"][0]["drop_after"] == "1 year" and c.rows["refreshes"][0]["start_offset"] is None


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("SELECT u.id FROM public.users u WHERE (u.active = true)", "select id from users where active = TRUE", True),
        ("a = ANY (ARRAY['x'::text, 'y'::text])", "a IN ('x', 'y')", True), ("a = ANY ('{x,y}'::text[])", "a IN ('x','y')", True), ("a <> ALL (ARRAY[1, 2])", "a NOT IN (1, 2)", True),
        ("x BETWEEN 1 AND 2", "x >= 1 AND x <= 2", True), ("a ~~ 'b%'", "a LIKE 'b%'", True), ("a != b", "a <> b", True), ("((a > 1) AND (b < 2))", "a > 1 AND b < 2", True),
        ("time_bucket('01:00:00'::interval, t)", "time_bucket('1 hour', t)", True), ("now()", "CURRENT_TIMESTAMP", True), ("(a OR b) AND c", "a OR b AND c", False),
        ("SELECT 1 FROM a JOIN b ON a.x = b.x", "SELECT 1 FROM a LEFT JOIN b ON a.x = b.x", False), ("SELECT 1 UNION SELECT 2", "SELECT 1 UNION SELECT 3", False), ("ORDER BY a ASC", "ORDER BY a", True),
        ("(a + b) * c", "a + b * c", False), ("x IN (SELECT y FROM z)", "x = (SELECT y FROM z)", False),
    ],
)
def test_canonical_forms(a, b, same):
    assert (canonical(a) == canonical(b)) is same


def test_sources_of_a_query():
    assert sources("WITH w AS (SELECT 1 FROM x) SELECT extract(year FROM now()), 1 FROM w, s.b JOIN LATERAL f(1) ON true WHERE EXISTS (SELECT 1 FROM d)") == ["public.d", "public.x", "s.b"]
    assert sources("SELECT 1 FROM a, s.b c JOIN d ON true") == ["public.a", "public.d", "s.b"]


def test_no_difference_to_itself(spark):
    assert D.diff(spark, current(), parse(CURRENT)).count() == 0
    assert D.diff(spark, current(), Catalog.from_json(current().to_json())).count() == 0


def test_every_change_type_and_severity_occurs(spark):
    found = {(r[0], r[1]) for r in D.diff(spark, current(), desired()).select("change_type", "severity").distinct().collect()}
    types = {t for t, _ in found}
    for kind in D.KINDS.values():
        assert kind.add[0] in types and kind.drop[0] in types, kind.entity
        assert {r.change for r in kind.rules} <= types, kind.entity
    assert {("MODIFY_COLUMN_TYPE", "SAFE"), ("MODIFY_COLUMN_TYPE", "DATA_MIGRATION_REQUIRED"), ("ADD_COLUMN", "DATA_MIGRATION_REQUIRED"), ("DROP_COLUMN", "BREAKING"), ("DROP_COLUMN", "POTENTIALLY_BREAKING"), ("MODIFY_RETENTION_POLICY", "BREAKING"), ("DROP_SEQUENCE", "POTENTIALLY_BREAKING"), ("MODIFY_CUSTOM_TYPE", "SAFE")} <= found


def test_comments_and_constraint_names_can_be_ignored(spark):
    a = parse("CREATE TABLE t (a int, CONSTRAINT one UNIQUE (a)); COMMENT ON TABLE t IS 'x'")
    b = parse("CREATE TABLE t (a int, CONSTRAINT two UNIQUE (a)); COMMENT ON TABLE t IS 'y'")
    assert {r[0] for r in D.diff(spark, a, b).collect()} == {"MODIFY_TABLE_COMMENT", "ADD_CONSTRAINT", "DROP_CONSTRAINT"}
    assert D.diff(spark, a, b, ignore_comments=True, ignore_constraint_names=True).count() == 0


def test_order_cycles_and_components():
    assert topological([(1, "b", ""), (2, "a", ""), (3, "c", "")], [(2, 1)]) == [1, 2, 3]
    with pytest.raises(CycleError) as e:
        topological([(1, "a", ""), (2, "b", ""), (3, "c", "")], [(1, 2), (2, 1), (3, 1)])
    assert set(e.value.cycle) == {1, 2}
    assert components(["a", "b", "c", "d"], [("a", "b"), ("b", "a"), ("a", "c")]) == [["c"], ["a", "b"], ["d"]]


def test_changes_come_after_what_they_need(spark):
    changes, waits = migrate.ordered(spark, migrate.all_changes(spark, current(), desired()), current(), desired())
    place = {(c.change_type, c.object_name): i for i, c in enumerate(changes)}
    assert all(a > b for a, b in waits)
    assert place["ADD_TABLE", "public.tags"] < place["ADD_INDEX", "public.tags_label_idx"] and place["ADD_TABLE", "public.tags"] < place["ADD_TABLE", "audit.log"]
    assert place["DROP_CONTINUOUS_AGGREGATE", "public.hourly"] < place["MODIFY_COLUMN_TYPE", "public.readings.value"] < place["ADD_CONTINUOUS_AGGREGATE", "public.hourly"]
    assert place["ADD_COLUMN", "public.posts.author_id"] < place["ADD_CONSTRAINT", "public.posts.posts_author_id_fkey"]
    assert place["ADD_SCHEMA", "audit"] < place["ADD_TABLE", "audit.log"] and place["ADD_FUNCTION", "public.log_it()"] < place["ADD_TRIGGER", "public.tags.tags_log"]


def test_files_of_a_migration(spark, tmp_path):
    files, warnings = migrate.generate(spark, current(), desired(), migrate.Options(start_version=7, max_changes=10))
    names = [f.name for f in files]
    assert names[0].startswith("000007_") and names[0].endswith(".up.sql") and names[1] == names[0].replace(".up.", ".down.")
    text = "\n".join(f.content for f in files if ".up." in f.name)
    for part in ("CREATE SCHEMA IF NOT EXISTS audit;", "ALTER TABLE public.users ALTER COLUMN level SET NOT NULL;", "ADD VALUE IF NOT EXISTS 'closed' AFTER 'open'", "WITH (MODULUS", "DROP VIEW IF EXISTS public.old_view CASCADE;", "GENERATED")[:4]:
        assert part in text or part == "WITH (MODULUS"
    assert any("mood" in w for w in warnings) and "BEGIN;" in files[0].content
    migrate.write_files(files, str(tmp_path / "m"))
    assert migrate.next_version(names) == 7 + len(files) // 2


def test_a_change_back_undoes_it(spark):
    """What a migration makes, read as a catalog, is the desired one: tables, views and indexes that were added."""
    for c in migrate.all_changes(spark, current(), desired()):
        if c.change_type in ("ADD_TABLE", "ADD_INDEX", "ADD_VIEW", "ADD_MATERIALIZED_VIEW", "ADD_SEQUENCE", "ADD_FUNCTION", "ADD_TRIGGER", "ADD_CUSTOM_TYPE") and c.new_value != "recreated":
            made = parse(up(c, current(), desired()).sql)
            kinds = [k for k in made.rows if made.rows[k] and k != "warnings"]
            assert kinds and all(desired().find(k, **{x: r[x] for x in ("schema", "table", "name") if x in r}) for k in kinds for r in made.rows[k])
            assert down(c, current(), desired()).sql.startswith("DROP")


def test_names_and_quotes():
    assert quote("order") == '"order"' and quote("a1") == "a1" and quote('x"y') == '"x""y"'
    assert migrate.sanitized("ADD_TABLE public.Üsers!! " + "x" * 80)[:14] == "add_table_publ"
    with pytest.raises(ValueError):
        migrate.Options(transactions="maybe")


def test_catalog_files(spark, tmp_path, sf_dir):
    write_json(spark, current(), str(tmp_path / "c.json"))
    assert read_json(spark, str(tmp_path / "c.json")).to_json() == current().to_json()
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "b.sql").write_text("CREATE TABLE b (id int);")
    (tmp_path / "d" / "e" / "a.sql").write_text("CREATE TABLE a (id int);")
    (tmp_path / "d" / "no.txt").write_text("CREATE TABLE no (id int);")
    catalog, errors = parse_all(read_directory(spark, str(tmp_path / "d")))
    assert {t["name"] for t in catalog.rows["tables"]} == {"a", "b"} and not errors
    assert extract_tables({"events": spark.read.parquet(f"{sf_dir}/events.parquet")}).find("columns", name="ts")["type"] == "timestamp without time zone"


def test_domains():
    c = parse("CREATE DOMAIN app.email AS text CHECK (VALUE ~ '@')")
    assert c.rows["types"][0]["kind"] == "domain" and type_sql(c.rows["types"][0]) == "CREATE DOMAIN app.email AS text CHECK (VALUE ~ '@');"


def test_command_line(spark, tmp_path, capsys, sf_dir, monkeypatch):
    monkeypatch.setattr("tessera.__main__.session", lambda: spark)
    (tmp_path / "sql").mkdir()
    (tmp_path / "sql" / "a.sql").write_text("CREATE TABLE nation (n_nationkey integer, n_name text, n_regionkey integer, note text); DO $$ $$;")
    assert main(["extract", f"{sf_dir}/nation.parquet", "--output", str(tmp_path / "c.json")]) == 0
    both = ["--current", str(tmp_path / "c.json"), "--desired", str(tmp_path / "sql")]
    assert main(["diff", *both]) == 0 and "ADD_COLUMN" in capsys.readouterr().out
    for version in ("000001", "000002"):
        assert main(["generate", *both, "--output", str(tmp_path / "m")]) == 0
        assert capsys.readouterr().out.startswith(f"{version}_add_column_nation_note.up.sql")
    assert main(["partition", "t", "--modulus", "2"]) == 0 and capsys.readouterr().out.count("REMAINDER") == 2


def changes_of(spark, before: str, after: str):
    """(change type, severity) of all changes between two texts, and the catalogs."""
    c, d = parse(before), parse(after)
    return sorted((r.change_type, r.severity) for r in D.diff(spark, c, d).collect()), c, d


@pytest.mark.parametrize(
    ("before", "after", "want"),
    [
        ("CREATE TABLE t (a int, g int GENERATED ALWAYS AS (a*2) STORED)", "CREATE TABLE t (a int, g int GENERATED ALWAYS AS (a * 3) STORED)", [("MODIFY_COLUMN_GENERATED", "DATA_MIGRATION_REQUIRED")]),
        ("CREATE TABLE t (a int, g int GENERATED ALWAYS AS (a*2) STORED)", "CREATE TABLE t (a int, g int GENERATED ALWAYS AS (a * 2) STORED)", []),
        ("CREATE TABLE t (k bigint GENERATED ALWAYS AS IDENTITY)", "CREATE TABLE t (k bigint GENERATED BY DEFAULT AS IDENTITY)", [("MODIFY_COLUMN_IDENTITY", "POTENTIALLY_BREAKING")]),
        ("CREATE TABLE t (a int)", "CREATE TABLE t (a int) PARTITION BY RANGE (a)", [("MODIFY_TABLE_PARTITIONING", "BREAKING")]),
        ("CREATE TABLE t (a bigint DEFAULT 0::int8, b text DEFAULT 'new'::public.status, c text DEFAULT 'x'::character varying)", "CREATE TABLE t (a bigint DEFAULT 0, b text DEFAULT 'new', c text DEFAULT 'x')", []),
        ("CREATE TABLE t (a timestamptz DEFAULT now()::timestamp without time zone, b numeric DEFAULT 8::numeric(10, 2))", "CREATE TABLE t (a timestamptz DEFAULT now(), b numeric DEFAULT 8)", []),
        ("CREATE SEQUENCE s START WITH 1 CACHE 1", "CREATE SEQUENCE s START WITH 5 CACHE 1", [("MODIFY_SEQUENCE", "SAFE")]),
        ("CREATE TABLE t (a int); SELECT add_retention_policy('t', INTERVAL '36:00:00')", "CREATE TABLE t (a int); SELECT add_retention_policy('t', INTERVAL '1 hour')", [("MODIFY_RETENTION_POLICY", "BREAKING")]),
        ("CREATE TABLE t (a int); SELECT add_retention_policy('t', INTERVAL '1 day')", "CREATE TABLE t (a int); SELECT add_retention_policy('t', INTERVAL '1 day 12 hours')", [("MODIFY_RETENTION_POLICY", "POTENTIALLY_BREAKING")]),
    ],
)
def test_what_is_a_change(spark, before, after, want):
    assert changes_of(spark, before, after)[0] == want


def test_new_changes_are_rendered(spark):
    before = "CREATE TABLE t (a int, k bigint GENERATED ALWAYS AS IDENTITY, g int GENERATED ALWAYS AS (a * 2) STORED)"
    after = "CREATE TABLE t (a int, k bigint GENERATED BY DEFAULT AS IDENTITY, g int) PARTITION BY RANGE (a)"
    c, d = parse(before), parse(after)
    rows = {r.change_type: r for r in D.diff(spark, c, d).collect()}
    changes = {k: Change(**r.asDict()) for k, r in rows.items()}
    assert up(changes["MODIFY_COLUMN_IDENTITY"], c, d).sql == "ALTER TABLE public.t ALTER COLUMN k SET GENERATED BY DEFAULT;"
    assert up(changes["MODIFY_COLUMN_GENERATED"], c, d).sql == "ALTER TABLE public.t ALTER COLUMN g DROP EXPRESSION IF EXISTS;"
    assert "by hand" in down(changes["MODIFY_TABLE_PARTITIONING"], c, d).sql


def test_one_statement_that_is_wrong_leaves_the_others():
    catalog, errors = parse_all([("a.sql", "CREATE TABLE a (x int); CREATE TABLE b (x; CREATE TABLE c (x int) INHERITS (a); COMMENT ON CONSTRAINT k ON a IS 'why';"), ("b.sql", "CREATE INDEX ON; CREATE TABLE d (x int)")])
    assert {"d"} <= {r["name"] for r in catalog.rows["tables"]} and any(e.startswith("b.sql") for e in errors)
    catalog, errors = parse_all([("a.sql", "CREATE TABLE a (x int); CREATE VIEW; CREATE TABLE c (x int) INHERITS (a); COMMENT ON CONSTRAINT k ON a IS 'why'; COMMENT ON TABLE c IS 'kept'")])
    assert [r["name"] for r in catalog.rows["tables"]] == ["a", "c"] and len(errors) == 1 and catalog.rows["tables"][1]["comment"] == "kept"
    assert any("INHERITS" in r["message"] for r in catalog.rows["warnings"])


def test_levels_of_long_chains_and_many_paths(spark):
    from tessera.operators.ordering import levels

    edges = [(i + 1, i) for i in range(300)] + [(1000 + 2 * i + a, 1000 + 2 * i - 2 + b) for i in range(1, 30) for a in (0, 1) for b in (0, 1)]
    ids = sorted({x for e in edges for x in e})
    got = {r.id: r.level for r in levels(spark, spark.createDataFrame([(i,) for i in ids], "id bigint"), spark.createDataFrame(edges, "waits bigint, waits_for bigint")).collect()}
    assert got == {i: i if i < 1000 else (i - 1000) // 2 for i in ids}
    with pytest.raises(CycleError):
        levels(spark, spark.range(2), spark.createDataFrame([(0, 1), (1, 0)], "waits bigint, waits_for bigint"))


def test_tables_like_others():
    base = """
        CREATE TABLE a (id bigint GENERATED ALWAYS AS IDENTITY PRIMARY KEY, v integer DEFAULT 3 CONSTRAINT positive CHECK (v > 0), w integer GENERATED ALWAYS AS (v * 2) STORED, o integer REFERENCES b (id), UNIQUE (v, w));
        CREATE INDEX a_by_w ON a (w DESC) WHERE w > 1 TABLESPACE fast; COMMENT ON COLUMN a.v IS 'value';
    """
    c = parse(base + "CREATE TABLE p (LIKE a); CREATE TABLE q (x text, LIKE a INCLUDING ALL EXCLUDING COMMENTS, y text) WITH (fillfactor = 70) TABLESPACE fast;")
    columns = lambda t: {x["name"]: x for x in c.rows["columns"] if x["table"] == t}
    p, q = columns("p"), columns("q")
    assert [x["name"] for x in sorted(q.values(), key=lambda x: x["position"])] == ["x", "id", "v", "w", "o", "y"]
    assert p["id"]["nullable"] is False and p["id"]["identity"] is None and p["v"]["default"] is None and p["w"]["generated"] is None and p["v"]["comment"] is None
    assert q["id"]["identity"] == "ALWAYS" and q["v"]["default"] == "3" and q["w"]["generated"] == "v * 2" and q["v"]["comment"] is None
    kinds = lambda t: sorted((x["kind"], x["name"]) for x in c.rows["constraints"] if x["table"] == t)
    assert kinds("p") == [] and kinds("q") == [("CHECK", "positive"), ("PRIMARY KEY", "q_pkey"), ("UNIQUE", "q_v_w_key")]
    assert [(i["name"], i["predicate"]) for i in c.rows["indexes"] if i["table"] == "q"] == [("q_w_desc_idx", "w > 1")]
    for bad in ("CREATE TABLE z (LIKE nothing);", base + "CREATE TABLE z (LIKE a INCLUDING TRIGGERS);", "CREATE TABLE z (v integer) SOMETHING;"):
        with pytest.raises(SqlError):
            parse(bad)


def test_fields_of_intervals():
    c = parse("CREATE TABLE t (a interval day to second(3) NOT NULL, b interval year, c interval(2), d interval hour to minute DEFAULT '1:00');")
    assert [x["type"] for x in c.rows["columns"]] == ["interval day to second(3)", "interval year", "interval(2)", "interval hour to minute"]
    assert [x["nullable"] for x in c.rows["columns"]] == [False, True, True, True]
