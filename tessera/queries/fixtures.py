"""A pair of declared schemas, between which every kind of change occurs, in its severities."""

from __future__ import annotations

from functools import cache

from tessera.sources.catalog import Catalog
from tessera.sources.ddl import parse

CURRENT = """
CREATE SCHEMA app; CREATE SCHEMA legacy;
CREATE EXTENSION pg_trgm WITH SCHEMA public VERSION '1.5'; CREATE EXTENSION hstore; CREATE EXTENSION citext VERSION '1.0';
CREATE TYPE status AS ENUM ('new', 'open'); CREATE TYPE mood AS ENUM ('ok', 'sad', 'off'); CREATE TYPE old_kind AS ENUM ('x'); CREATE TYPE pair AS (a integer, b integer);
CREATE SEQUENCE ticket_seq INCREMENT BY 1; CREATE SEQUENCE loose_seq; CREATE SEQUENCE owned_seq OWNED BY users.id;
CREATE TABLE users (
  id bigserial PRIMARY KEY, name varchar(50) NOT NULL, email character varying(255) UNIQUE, age int CHECK (age >= 0), nick text, code smallint, amount numeric(10,2), note text NOT NULL,
  created_at timestamptz DEFAULT now(), active bool DEFAULT true, level integer, CONSTRAINT level_ok CHECK (level BETWEEN 1 AND 10));
COMMENT ON TABLE users IS 'people'; COMMENT ON COLUMN users.name IS 'full   name';
CREATE TABLE posts (id bigint PRIMARY KEY, user_id bigint NOT NULL REFERENCES users (id) ON DELETE CASCADE, title text, body text, legacy_id int NOT NULL, CONSTRAINT title_key UNIQUE (title));
CREATE TABLE gone (id int PRIMARY KEY, user_id bigint REFERENCES users(id)); COMMENT ON TABLE posts IS 'things written';
CREATE TABLE readings (ts timestamptz NOT NULL, device_id text NOT NULL, value double precision, quality int);
CREATE TABLE orders (id bigint, created_at timestamptz NOT NULL, total numeric(12,2)) PARTITION BY RANGE (created_at);
CREATE TABLE orders_2024 PARTITION OF orders FOR VALUES FROM ('2024-01-01') TO ('2025-01-01'); CREATE TABLE orders_2023 PARTITION OF orders FOR VALUES FROM ('2023-01-01') TO ('2024-01-01');
CREATE TABLE moved (id bigint GENERATED ALWAYS AS IDENTITY, a int, twice int GENERATED ALWAYS AS (a * 2) STORED, plain int GENERATED ALWAYS AS (a + 1) STORED);
CREATE TABLE old_points (ts timestamptz NOT NULL, v int);
CREATE INDEX users_name_idx ON users (name); CREATE UNIQUE INDEX users_nick_uq ON users (nick); CREATE INDEX posts_title_idx ON posts USING btree (lower(title)) WHERE title IS NOT NULL; CREATE INDEX posts_body_idx ON posts (body);
CREATE VIEW active_users AS SELECT u.id, u.name FROM users u WHERE u.active = true; CREATE VIEW old_view AS SELECT id FROM posts; CREATE VIEW leveled AS SELECT id FROM users WHERE level IN (1);
CREATE VIEW checked AS SELECT id, age FROM users WHERE age > 3 WITH LOCAL CHECK OPTION;
CREATE MATERIALIZED VIEW post_counts AS SELECT user_id, count(*) AS n FROM posts GROUP BY user_id; CREATE MATERIALIZED VIEW old_mv AS SELECT 1 AS one;
CREATE FUNCTION touch() RETURNS trigger LANGUAGE plpgsql AS $$ BEGIN NEW.created_at = now(); RETURN NEW; END $$;
CREATE FUNCTION add(a int, b int) RETURNS int LANGUAGE sql IMMUTABLE AS $$ SELECT a + b $$; CREATE FUNCTION drop_me(x text) RETURNS text LANGUAGE sql AS $$ SELECT x $$; CREATE FUNCTION same(x int) RETURNS int LANGUAGE sql AS $$ SELECT   x $$;
CREATE TRIGGER users_touch BEFORE UPDATE ON users FOR EACH ROW EXECUTE FUNCTION touch(); CREATE TRIGGER posts_touch AFTER INSERT OR UPDATE ON posts FOR EACH ROW EXECUTE FUNCTION touch();
SELECT create_hypertable('readings', 'ts', chunk_time_interval => INTERVAL '1 day'); SELECT create_hypertable('old_points', by_range('ts', INTERVAL '7 days'));
ALTER TABLE readings SET (timescaledb.compress, timescaledb.compress_segmentby = 'device_id', timescaledb.compress_orderby = 'ts DESC'); SELECT add_compression_policy('readings', INTERVAL '7 days');
ALTER TABLE old_points SET (timescaledb.compress); SELECT add_retention_policy('readings', INTERVAL '90 days'); SELECT add_retention_policy('old_points', INTERVAL '1 year');
CREATE MATERIALIZED VIEW hourly WITH (timescaledb.continuous) AS SELECT time_bucket('1 hour', ts) AS bucket, device_id, avg(value) AS mean FROM readings GROUP BY 1, 2;
CREATE MATERIALIZED VIEW old_daily WITH (timescaledb.continuous) AS SELECT time_bucket('1 day', ts) AS bucket, count(*) AS n FROM readings GROUP BY 1;
SELECT add_continuous_aggregate_policy('hourly', start_offset => INTERVAL '2 days', end_offset => INTERVAL '1 hour', schedule_interval => INTERVAL '1 hour');
SELECT add_continuous_aggregate_policy('old_daily', INTERVAL '3 days', INTERVAL '1 day', INTERVAL '1 day');
"""

DESIRED = """
CREATE SCHEMA app; CREATE SCHEMA audit;
CREATE EXTENSION pg_trgm WITH SCHEMA public VERSION '1.6'; CREATE EXTENSION citext; CREATE EXTENSION btree_gist;
CREATE TYPE status AS ENUM ('new', 'open', 'closed'); CREATE TYPE mood AS ENUM ('ok', 'off'); CREATE TYPE kind AS ENUM ('a'); CREATE TYPE pair AS (a bigint, b integer);
CREATE SEQUENCE ticket_seq INCREMENT BY 5 CYCLE; CREATE SEQUENCE fresh_seq START WITH 10;
CREATE TABLE users (
  id bigserial PRIMARY KEY, name varchar(100) NOT NULL, email varchar(255) UNIQUE, age int8 CHECK (age >= 0), code varchar(10), amount decimal(12, 2), note text,
  created_at TIMESTAMPTZ DEFAULT CURRENT_TIMESTAMP, active boolean DEFAULT false, level integer NOT NULL, city text NOT NULL, zip text DEFAULT '', CONSTRAINT level_ok CHECK (level >= 1 AND level <= 20),
  CONSTRAINT city_set CHECK (city IS NOT NULL), CONSTRAINT age_key UNIQUE (age));
COMMENT ON TYPE status IS 'where it stands'; COMMENT ON EXTENSION citext IS 'text of any case'; COMMENT ON TABLE users IS 'all people'; COMMENT ON COLUMN users.name IS 'full name'; COMMENT ON COLUMN users.email IS 'where to write';
CREATE TABLE posts (id bigint PRIMARY KEY, user_id bigint NOT NULL REFERENCES users (id) ON DELETE SET NULL, title text, body text, author_id bigint REFERENCES users(id));
CREATE TABLE tags (id bigint PRIMARY KEY, post_id bigint REFERENCES posts(id), label text NOT NULL); CREATE TABLE audit.log (id bigint PRIMARY KEY, tag_id bigint REFERENCES tags(id), at timestamptz NOT NULL);
CREATE TABLE moved (id bigint GENERATED BY DEFAULT AS IDENTITY, a int, twice int GENERATED ALWAYS AS (a * 3) STORED, plain int) PARTITION BY RANGE (a);
CREATE TABLE readings (ts timestamptz NOT NULL, device_id text NOT NULL, value numeric(20,4), quality int);
CREATE TABLE orders (id bigint, created_at timestamptz NOT NULL, total numeric(12,2)) PARTITION BY RANGE (created_at);
CREATE TABLE orders_2024 PARTITION OF orders FOR VALUES FROM ('2024-01-01') TO ('2025-07-01'); CREATE TABLE orders_2025 PARTITION OF orders FOR VALUES FROM ('2025-07-01') TO ('2026-01-01');
CREATE TABLE points (ts timestamptz NOT NULL, v int);
CREATE INDEX users_name_idx ON users (lower(name)); CREATE UNIQUE INDEX posts_body_idx ON posts (body); CREATE INDEX posts_title_idx ON posts USING btree (lower(title)) WHERE (title IS NOT NULL); CREATE INDEX tags_label_idx ON tags USING gin (label) WITH (fastupdate = off);
CREATE VIEW active_users AS SELECT id, name AS name FROM users WHERE (active = true); CREATE VIEW leveled AS SELECT id FROM users WHERE level = 1; CREATE VIEW new_view AS SELECT t.id, p.title FROM tags t JOIN posts p ON p.id = t.post_id;
CREATE VIEW checked AS SELECT id, age FROM users WHERE age > 5 WITH CASCADED CHECK OPTION; COMMENT ON VIEW leveled IS 'those of the first level';
CREATE MATERIALIZED VIEW post_counts AS SELECT user_id, count(*) AS n, max(title) AS last FROM posts GROUP BY user_id; CREATE MATERIALIZED VIEW tag_counts AS SELECT label, count(*) AS n FROM tags GROUP BY label WITH NO DATA;
CREATE FUNCTION touch() RETURNS trigger LANGUAGE plpgsql AS $$ BEGIN NEW.created_at = clock_timestamp(); RETURN NEW; END $$;
CREATE FUNCTION add(a int, b int) RETURNS int LANGUAGE sql STABLE AS $$ SELECT a + b $$; CREATE FUNCTION log_it() RETURNS trigger LANGUAGE plpgsql AS $$ BEGIN RETURN NULL; END $$; CREATE FUNCTION same(x int) RETURNS int LANGUAGE sql AS $body$ SELECT x $body$;
CREATE TRIGGER users_touch BEFORE INSERT OR UPDATE ON users FOR EACH ROW EXECUTE FUNCTION touch(); CREATE TRIGGER tags_log AFTER DELETE ON tags FOR EACH STATEMENT EXECUTE FUNCTION log_it();
SELECT create_hypertable('readings', 'ts', chunk_time_interval => INTERVAL '12 hours'); SELECT create_hypertable('points', by_range('ts', INTERVAL '7 days'));
ALTER TABLE readings SET (timescaledb.compress, timescaledb.compress_segmentby = 'device_id', timescaledb.compress_orderby = 'ts ASC'); SELECT add_compression_policy('readings', INTERVAL '7 days');
ALTER TABLE points SET (timescaledb.compress); SELECT add_compression_policy('points', INTERVAL '30 days'); SELECT add_retention_policy('readings', INTERVAL '9 weeks'); SELECT add_retention_policy('points', INTERVAL '1 year');
CREATE MATERIALIZED VIEW hourly WITH (timescaledb.continuous) AS SELECT time_bucket('01:00:00', ts) AS bucket, device_id, avg(value) AS mean, count(*) AS n FROM readings GROUP BY 1, 2;
CREATE MATERIALIZED VIEW weekly WITH (timescaledb.continuous) AS SELECT time_bucket('7 days', ts) AS bucket, count(*) AS n FROM points GROUP BY 1 WITH NO DATA;
SELECT add_continuous_aggregate_policy('hourly', start_offset => INTERVAL '4 days', end_offset => INTERVAL '60 minutes', schedule_interval => INTERVAL '1 hour');
SELECT add_continuous_aggregate_policy('weekly', INTERVAL '1 month', INTERVAL '1 day', INTERVAL '1 day');
"""


@cache
def current() -> Catalog:
    return parse(CURRENT)


@cache
def desired() -> Catalog:
    return parse(DESIRED)
