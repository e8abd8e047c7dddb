"""Queries that go through sessions: the dialect's functions and operators, search predicates, changes, graphs, Cypher and the
fluent builder, each with SQL for the same rows where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import signals
from weft.operators.signals import ID, SCORE
from weft.plans import search
from weft.plans.search import OTHER, QUERY, rounded
from weft.session import Session

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "benchmark": "item_id", "labels": "doc_id"}
SQL: dict[str, str] = {}
RUN: dict = {}


def session(spark: SparkSession, sf_dir: str) -> Session:
    """A session over the tables of a folder."""
    s = Session(spark)
    for name, key in KEYS.items():
        s.register(name, search.table(spark, sf_dir, name), key, {"text": "plain"} if name == "documents" else None)
    return s


def query(name: str, oracle: str | None = None):
    def add(f):
        RUN[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def statement(name: str, text: str, oracle: str | None, digits: int | None = None) -> None:
    """A query of one or more statements, of which the last has rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = session(spark, sf_dir).sql(text)
        return rounded(df, digits) if digits else df

    query(name, oracle)(run)


# --- functions -----------------------------------------------------------------------------------------------------------------

statement("session_trim_pad", "SELECT c_custkey, btrim(c_name, 'Cr0') AS b, ltrim(c_name, 'Cu') AS l, rtrim(c_name, '0123456789') AS r, trim('  ' || c_mktsegment || ' ') AS t, lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 3, '-') AS rp, concat(c_mktsegment, NULL, '!') AS c, concat_ws('-', c_mktsegment, NULL, c_name) AS cw FROM customer", "SELECT c_custkey, trim(c_name, 'Cr0') AS b, ltrim(c_name, 'Cu') AS l, rtrim(c_name, '0123456789') AS r, trim('  ' || c_mktsegment || ' ') AS t, lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 3, '-') AS rp, concat(c_mktsegment, NULL, '!') AS c, concat_ws('-', c_mktsegment, NULL, c_name) AS cw FROM customer")
statement("session_slices", "SELECT c_custkey, left(c_name, 4) AS l, left(c_name, -12) AS ln, right(c_name, 3) AS r, right(c_name, 0) AS r0, substring(c_name, 3, 5) AS s, substring(c_name from 10) AS sf, split_part(c_name, '#', 2) AS p, split_part(c_name, '#', 5) AS p5, strpos(c_name, '#') AS at, position('0' in c_name) AS pos, starts_with(c_name, 'Cust') AS sw, overlay(c_name placing 'XY' from 2 for 3) AS o FROM customer", "SELECT c_custkey, left(c_name, 4) AS l, left(c_name, -12) AS ln, right(c_name, 3) AS r, '' AS r0, substring(c_name, 3, 5) AS s, substring(c_name, 10) AS sf, split_part(c_name, '#', 2) AS p, split_part(c_name, '#', 5) AS p5, CAST(strpos(c_name, '#') AS INT) AS at, CAST(position('0' in c_name) AS INT) AS pos, starts_with(c_name, 'Cust') AS sw, left(c_name, 1) || 'XY' || substring(c_name, 5) AS o FROM customer")
statement("session_case_codes", "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, initcap(p_name || '-x' || p_type) AS i, length(p_name) AS n, char_length(p_name) AS cn, character_length(p_name) AS chn, octet_length(p_name || 'é') AS o, ascii(p_name) AS a, chr(8364 + p_size) AS c, md5(p_name) AS m, reverse(p_name) AS r, repeat(p_brand, 2) AS rep, replace(p_name, ' ', '_') AS repl, translate(p_name, 'aeiou', 'AE') AS t FROM part", "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, array_to_string(list_transform(regexp_extract_all(p_name || '-x' || p_type, '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1]) || lower(w[2:])), '') AS i, CAST(length(p_name) AS INT) AS n, CAST(length(p_name) AS INT) AS cn, CAST(length(p_name) AS INT) AS chn, CAST(octet_length(encode(p_name || 'é')) AS INT) AS o, CAST(ascii(p_name) AS INT) AS a, chr(8364 + p_size) AS c, md5(p_name) AS m, reverse(p_name) AS r, repeat(p_brand, 2) AS rep, replace(p_name, ' ', '_') AS repl, translate(p_name, 'aeiou', 'AE') AS t FROM part")
statement("session_format_encode", "SELECT c_custkey, format('%s of %I is %L', c_name, c_mktsegment, c_nationkey) AS f, encode(c_name, 'base64') AS b, encode(c_name, 'hex') AS h, decode(encode(c_name, 'base64'), 'base64') AS db, decode(encode(c_name, 'hex'), 'hex') AS dh FROM customer", "SELECT c_custkey, c_name || ' of ' || c_mktsegment || ' is ''' || c_nationkey || '''' AS f, to_base64(encode(c_name)) AS b, lower(hex(encode(c_name))) AS h, c_name AS db, c_name AS dh FROM customer")
statement("session_regexp", "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '_') AS first, regexp_replace(p_name, '[AEIOU]', '_', 'gi') AS every, regexp_replace(p_brand, '(\\w+)#(\\d)', '\\2-\\1') AS swapped, regexp_match(p_brand, '(\\w)#(\\d)') AS m, regexp_matches(p_name, '[aeiou]', 'g') AS ms, regexp_split_to_array(p_name, '\\s+') AS parts FROM part", "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '_') AS first, regexp_replace(p_name, '[AEIOU]', '_', 'gi') AS every, regexp_replace(p_brand, '(\\w+)#(\\d)', '\\2-\\1') AS swapped, [regexp_extract(p_brand, '(\\w)#(\\d)', 1), regexp_extract(p_brand, '(\\w)#(\\d)', 2)] AS m, list_transform(regexp_extract_all(p_name, '[aeiou]'), lambda x: [x]) AS ms, regexp_split_to_array(p_name, '\\s+') AS parts FROM part")
statement("session_integer_math", "SELECT o_orderkey, o_orderkey / 7 AS q, o_orderkey % 7 AS r, o_custkey / (o_orderkey % 3) AS z, div(o_orderkey, 4) AS d, mod(o_orderkey, 5) AS m, gcd(o_orderkey, o_custkey) AS g, lcm(o_orderkey, o_custkey) AS l, abs(-o_orderkey) AS a, sign(o_custkey - 500) AS s FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS q, o_orderkey % 7 AS r, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey // (o_orderkey % 3) END AS z, o_orderkey // 4 AS d, o_orderkey % 5 AS m, gcd(o_orderkey, o_custkey) AS g, lcm(o_orderkey, o_custkey) AS l, o_orderkey AS a, CAST(sign(o_custkey - 500) AS DOUBLE) AS s FROM orders")
statement("session_rounding", "SELECT o_orderkey, trunc(o_totalprice) AS t, trunc(-o_totalprice, 1) AS t1, CAST(ceil(o_totalprice) AS BIGINT) AS c, CAST(ceiling(o_totalprice) AS BIGINT) AS cc, CAST(floor(-o_totalprice) AS BIGINT) AS f, round(o_custkey + 0.5::double precision) AS even, width_bucket(o_totalprice, 1000.0::float8, 400000.0::float8, 8) AS w, trim_scale(o_totalprice) AS ts, sqrt(o_totalprice) AS sq, cbrt(o_totalprice) AS cb, ln(o_totalprice) AS n, log(o_totalprice) AS lg, log(2, o_totalprice) AS l2, exp(o_custkey / 1000.0::float8) AS e, power(o_custkey, 2) AS p FROM orders", "SELECT o_orderkey, trunc(o_totalprice) AS t, -floor(o_totalprice * 10) / 10 AS t1, CAST(ceil(o_totalprice) AS BIGINT) AS c, CAST(ceil(o_totalprice) AS BIGINT) AS cc, CAST(floor(-o_totalprice) AS BIGINT) AS f, CAST(round_even(o_custkey + 0.5::DOUBLE, 0) AS DOUBLE) AS even, CAST(CASE WHEN o_totalprice < 1000 THEN 0 WHEN o_totalprice >= 400000 THEN 9 ELSE floor((o_totalprice - 1000) / (399000 / 8.0)) + 1 END AS INT) AS w, o_totalprice AS ts, sqrt(o_totalprice) AS sq, cbrt(o_totalprice) AS cb, ln(o_totalprice) AS n, log10(o_totalprice) AS lg, log2(o_totalprice) AS l2, exp(o_custkey / 1000.0::DOUBLE) AS e, power(o_custkey::DOUBLE, 2) AS p FROM orders", 6)
SQL["session_rounding"] = f"SELECT {', '.join(f'round({c}, 6) AS {c}' if c in ('t', 't1', 'even', 'ts', 'sq', 'cb', 'n', 'lg', 'l2', 'e', 'p') else c for c in 'o_orderkey t t1 c cc f even w ts sq cb n lg l2 e p'.split())} FROM ({SQL['session_rounding']})"
statement("session_trigonometry", "SELECT n_nationkey, sin(n_nationkey) AS s, cos(n_nationkey) AS c, tan(n_nationkey) AS t, asin(n_nationkey / 25.0::float8) AS a, acos(n_nationkey / 25.0::float8) AS ac, atan(n_nationkey) AS at, atan2(n_nationkey, 3) AS a2, degrees(n_nationkey) AS d, radians(n_nationkey) AS r, pi() AS p, random() < 1 AS rd FROM nation", "SELECT n_nationkey, round(sin(n_nationkey), 6) AS s, round(cos(n_nationkey), 6) AS c, round(tan(n_nationkey), 6) AS t, round(asin(n_nationkey / 25.0::DOUBLE), 6) AS a, round(acos(n_nationkey / 25.0::DOUBLE), 6) AS ac, round(atan(n_nationkey), 6) AS at, round(atan2(n_nationkey, 3), 6) AS a2, round(degrees(n_nationkey), 6) AS d, round(radians(n_nationkey), 6) AS r, round(pi(), 6) AS p, true AS rd FROM nation", 6)
statement("session_datetime", "SELECT o_orderkey, extract(year from o_orderdate) AS y, extract(month from o_orderdate) AS m, extract(day from o_orderdate) AS d, extract(dow from o_orderdate) AS dow, extract(doy from o_orderdate) AS doy, extract(week from o_orderdate) AS w, extract(quarter from o_orderdate) AS q, date_part('hour', o_orderdate) AS h, CAST(date_part('epoch', o_orderdate) AS DOUBLE) AS e, date_trunc('month', o_orderdate) AS tr, to_char(o_orderdate, 'YYYY-MM-DD HH24:MI:SS') AS c, to_char(o_orderdate, 'DD Mon YYYY') AS c2, to_date(to_char(o_orderdate, 'DD.MM.YYYY'), 'DD.MM.YYYY') AS td, to_timestamp(to_char(o_orderdate, 'YYYYMMDD'), 'YYYYMMDD') AS tt, CASE WHEN extract(day from o_orderdate) < 31 THEN make_date(1998, 1, 1 + extract(day from o_orderdate)) END AS md, isfinite(o_orderdate) AS fin, overlaps(o_orderdate, o_orderdate, DATE '1995-01-01', DATE '1997-01-01') AS ov FROM orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(dayofweek(o_orderdate) AS INT) AS dow, CAST(dayofyear(o_orderdate) AS INT) AS doy, CAST(week(o_orderdate) AS INT) AS w, CAST(quarter(o_orderdate) AS INT) AS q, CAST(hour(o_orderdate) AS INT) AS h, epoch(o_orderdate) AS e, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS tr, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS c, strftime(o_orderdate, '%d %b %Y') AS c2, CAST(o_orderdate AS DATE) AS td, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS tt, CASE WHEN day(o_orderdate) < 31 THEN make_date(1998, 1, 1 + day(o_orderdate)) END AS md, true AS fin, (o_orderdate < TIMESTAMP '1997-01-01' AND TIMESTAMP '1995-01-01' < o_orderdate) AS ov FROM orders")
statement("session_intervals", "SELECT o_orderkey, age(o_orderdate, TIMESTAMP '1990-01-01') AS a, make_interval(0, 0, 0, 1, o_custkey % 24, 5, 6) AS i, CAST(make_timestamp(1999, 12, 31, 23, o_custkey % 60, 30) AS TIMESTAMP) AS t, to_number('$' || o_orderkey || ',000.5', '999') AS n, now() > TIMESTAMP '2020-01-01' AS w, length(clock_timestamp()) AS ct, length(timeofday()) > 20 AS td FROM orders", "WITH x AS (SELECT *, abs(date_diff('day', TIMESTAMP '1990-01-01', o_orderdate)) AS d FROM orders) SELECT o_orderkey, concat_ws(' ', CASE WHEN d // 365 > 0 THEN (d // 365) || ' years' END, CASE WHEN d % 365 // 30 > 0 THEN (d % 365 // 30) || ' mons' END, CASE WHEN d % 365 % 30 > 0 OR d = 0 THEN (d % 365 % 30) || ' days' END) AS a, printf('%02d:05:06', 24 + o_custkey % 24) AS i, make_timestamp(1999, 12, 31, 23, o_custkey % 60, 30.0) AS t, CAST(o_orderkey || '000.5' AS DOUBLE) AS n, true AS w, 26 AS ct, true AS td FROM x")
statement("session_json", "SELECT event_id, props ->> 'k' AS k, props::jsonb #>> '{k}' AS p, json_extract_path_text(props, 'k') AS x, json_extract_path(jsonb_build_object('a', jsonb_build_array(event_id, event_type)), 'a', '1') AS y, json_typeof(props) AS t, jsonb_typeof('[1]') AS ta, jsonb_build_object('id', event_id, 'kind', event_type) AS o, json_build_array(event_id, event_type, NULL) AS a, jsonb_array_length('[1, 2, 3]') AS n, json_object_keys(props) AS ks FROM events", "SELECT event_id, props ->> 'k' AS k, props ->> 'k' AS p, props ->> 'k' AS x, event_type AS y, 'object' AS t, 'array' AS ta, '{\"id\":' || event_id || ',\"kind\":\"' || event_type || '\"}' AS o, '[' || event_id || ',\"' || event_type || '\",null]' AS a, 3 AS n, json_keys(props) AS ks FROM events")
statement("session_json_changes", "SELECT event_id, props @> '{\"k\": 1}' AS c, '{\"k\": 1}' <@ props AS d, props ? 'k' AS h, props ?| ARRAY['x', 'k'] AS some, props ?& ARRAY['x', 'k'] AS every, jsonb_set(props, '{k}', '5') AS s, jsonb_set(props, '{z}', '5', false) AS u, jsonb_insert(props, '{z}', '7') ->> 'z' AS i, jsonb_strip_nulls('{\"a\": null, \"b\": 1}') AS n, to_json(event_type) AS j, to_jsonb(event_id) AS b FROM events", "SELECT event_id, CAST(props ->> 'k' AS INT) = 1 AS c, CAST(props ->> 'k' AS INT) = 1 AS d, true AS h, true AS some, false AS every, '{\"k\":5}' AS s, '{\"k\":' || (props ->> 'k') || '}' AS u, '7' AS i, '{\"b\":1}' AS n, '\"' || event_type || '\"' AS j, CAST(event_id AS VARCHAR) AS b FROM events")
statement("session_arrays", "SELECT o_orderkey, array_length(ARRAY[o_custkey, 2], 1) AS l, array_upper(ARRAY[o_custkey, 2], 1) AS u, array_lower(ARRAY[o_custkey, 2], 1) AS lo, cardinality(ARRAY[1, 2, 3]) AS n, array_cat(ARRAY[o_custkey], ARRAY[o_orderkey]) AS c, array_append(ARRAY[o_custkey], o_orderkey) AS a, array_remove(ARRAY[o_custkey, o_orderkey], o_custkey) AS r, length(gen_random_uuid()) AS g, typeof(o_custkey) AS ti, typeof(o_orderstatus) AS tt, typeof(o_totalprice) AS tr FROM orders", "SELECT o_orderkey, 2 AS l, 2 AS u, 1 AS lo, 3 AS n, [o_custkey, o_orderkey] AS c, [o_custkey, o_orderkey] AS a, list_filter([o_custkey, o_orderkey], lambda x: x <> o_custkey) AS r, 36 AS g, 'integer' AS ti, 'text' AS tt, 'real' AS tr FROM orders")
statement("session_places", f"SELECT c_custkey, st_distance(POINT(c_custkey * 37 % 360 - 180, c_custkey * 17 % 180 - 90), POINT(11, 48)) AS metres, st_within(POINT(c_custkey * 37 % 360 - 180, c_custkey * 17 % 180 - 90), POINT(11, 48), 3000000) AS w, st_dwithin(POINT(c_custkey * 37 % 360 - 180, c_custkey * 17 % 180 - 90), POINT(11, 48), 5000000) AS d FROM customer", f"SELECT c_custkey, round(m, 2) AS metres, m <= 3000000 AS w, m <= 5000000 AS d FROM (SELECT c_custkey, {search._HAVERSINE} AS m FROM {search._PLACES})", 2)

# --- what Spark's own SQL has not, or says otherwise -----------------------------------------------------------------------------

statement("session_window_filter", "SELECT o_orderkey, sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS s, count(*) FILTER (WHERE o_totalprice > 100000) OVER (PARTITION BY o_custkey) AS n FROM orders", "SELECT o_orderkey, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey), 4) AS s, count(*) FILTER (WHERE o_totalprice > 100000) OVER (PARTITION BY o_custkey) AS n FROM orders", 4)
statement("session_quantified", "SELECT o_orderkey, o_totalprice >= ALL (SELECT o_totalprice FROM orders WHERE o_orderstatus = 'F') AS top, o_totalprice < ANY (SELECT o_totalprice FROM orders WHERE o_orderstatus = 'P') AS some FROM orders WHERE o_custkey = ANY (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderstatus <> ALL (SELECT l_linestatus FROM lineitem WHERE l_linestatus = 'O')", "SELECT o_orderkey, o_totalprice >= ALL (SELECT o_totalprice FROM orders WHERE o_orderstatus = 'F') AS top, o_totalprice < ANY (SELECT o_totalprice FROM orders WHERE o_orderstatus = 'P') AS some FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderstatus <> 'O'")
statement("session_order_fetch", "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS m FROM customer ORDER BY m DESC, c_custkey FETCH FIRST 12 ROWS ONLY", "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS m FROM customer ORDER BY m DESC NULLS FIRST, c_custkey LIMIT 12")
statement("session_aggregates", "SELECT o_orderpriority, string_agg(o_orderstatus, ',' ORDER BY o_orderkey) AS s, array_agg(o_custkey ORDER BY o_orderkey DESC) AS a, bool_and(o_totalprice > 0) AS b, every(o_totalprice > 100000) AS e, count(DISTINCT o_custkey) AS d, percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice) AS p, mode() WITHIN GROUP (ORDER BY o_orderpriority) AS m FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, string_agg(o_orderstatus, ',' ORDER BY o_orderkey) AS s, list(o_custkey ORDER BY o_orderkey DESC) AS a, bool_and(o_totalprice > 0) AS b, bool_and(o_totalprice > 100000) AS e, count(DISTINCT o_custkey) AS d, round(quantile_cont(o_totalprice, 0.5), 4) AS p, o_orderpriority AS m FROM orders GROUP BY o_orderpriority", 4)
statement("session_recursive", "WITH RECURSIVE r(n) AS (SELECT 1 UNION SELECT (n * 3) % 19 FROM r) SELECT n FROM r", "WITH RECURSIVE r(n) AS (SELECT 1 UNION SELECT (n * 3) % 19 FROM r) SELECT n FROM r")
statement("session_series", "SELECT g.generate_series AS k, n_name FROM generate_series(0, 24, 6) g LEFT JOIN nation ON n_nationkey = g.generate_series", "SELECT k, n_name FROM (SELECT CAST(unnest(range(0, 25, 6)) AS INT) AS k) LEFT JOIN nation ON n_nationkey = k")
statement("session_table_functions", "SELECT 'unnest' AS f, CAST(unnest AS STRING) AS v FROM unnest(ARRAY[3, 1, 2]) UNION ALL SELECT 'split', regexp_split_to_table FROM regexp_split_to_table('aXbxc', 'x', 'i') UNION ALL SELECT 'each', key || '=' || value FROM json_each('{\"a\": 1, \"b\": \"x\"}') UNION ALL SELECT 'text', key || '=' || value FROM jsonb_each_text('{\"c\": 2}') UNION ALL SELECT 'elements', value FROM json_array_elements('[7, 8]') UNION ALL SELECT 'words', value FROM jsonb_array_elements_text('[\"p\", \"q\"]')", "VALUES ('unnest', '3'), ('unnest', '1'), ('unnest', '2'), ('split', 'a'), ('split', 'b'), ('split', 'c'), ('each', 'a=1'), ('each', 'b=x'), ('text', 'c=2'), ('elements', '7'), ('elements', '8'), ('words', 'p'), ('words', 'q')")
SQL["session_table_functions"] = f"SELECT * FROM ({SQL['session_table_functions']}) AS t(f, v)"
statement("session_prepared", "PREPARE of_customer AS SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = $1 AND o_totalprice > $2; EXECUTE of_customer(7, 1000.0)", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 AND o_totalprice > 1000.0")
statement("session_view", "CREATE VIEW rich AS SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 5000; SELECT n_name, count(*) AS n FROM rich JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000 GROUP BY n_name")
statement("session_catalog", "SELECT table_name, column_name, ordinal_position FROM information_schema.columns WHERE table_name IN ('nation', 'labels')", "VALUES ('nation', 'n_nationkey', 1), ('nation', 'n_name', 2), ('nation', 'n_regionkey', 3), ('labels', 'doc_id', 1), ('labels', 'quality', 2), ('labels', 'toxic', 3)")
SQL["session_catalog"] = f"SELECT * FROM ({SQL['session_catalog']}) AS t(table_name, column_name, ordinal_position)"

# --- changes ---------------------------------------------------------------------------------------------------------------------

statement("dml_insert_update_delete", "CREATE TABLE n AS SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation; INSERT INTO n (k, name, r) SELECT 100 + r_regionkey, r_name, r_regionkey FROM region; UPDATE n SET name = lower(name), r = r + 1 WHERE k % 2 = 0; DELETE FROM n WHERE r = 3; SELECT k, name, r FROM n", "WITH n AS (SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation UNION ALL SELECT 100 + r_regionkey, r_name, r_regionkey FROM region), u AS (SELECT k, CASE WHEN k % 2 = 0 THEN lower(name) ELSE name END AS name, CASE WHEN k % 2 = 0 THEN r + 1 ELSE r END AS r FROM n) SELECT k, name, r FROM u WHERE r <> 3")
statement("dml_upsert", "CREATE TABLE n (k INT PRIMARY KEY, v INT DEFAULT 5, name TEXT); INSERT INTO n (k, name) SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 10; INSERT INTO n (k, v, name) SELECT n_nationkey, 1, 'new' FROM nation WHERE n_nationkey BETWEEN 5 AND 14 ON CONFLICT (k) DO UPDATE SET v = v + excluded.v; INSERT INTO n (k, v, name) VALUES (1, 0, 'x'), (99, 0, 'y') ON CONFLICT (k) DO NOTHING; SELECT k, v, name FROM n", "SELECT n_nationkey AS k, CASE WHEN n_nationkey < 5 THEN 5 WHEN n_nationkey < 10 THEN 6 ELSE 1 END AS v, CASE WHEN n_nationkey < 10 THEN n_name ELSE 'new' END AS name FROM nation WHERE n_nationkey < 15 UNION ALL SELECT 99, 0, 'y'")
statement("dml_returning", "CREATE TABLE n (id SERIAL PRIMARY KEY, name TEXT NOT NULL, r INT); INSERT INTO n (name, r) VALUES ('a', 1), ('b', 2), ('c', 3); UPDATE n SET r = r * 10 WHERE r > 1 RETURNING id, name, r", "SELECT * FROM (VALUES (2, 'b', 20), (3, 'c', 30)) AS t(id, name, r)")
statement("dml_update_from", "CREATE TABLE c AS SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS m FROM customer; UPDATE c SET m = nation.n_name FROM nation WHERE c.n = nation.n_nationkey AND nation.n_regionkey = 2; DELETE FROM c USING nation WHERE c.n = nation.n_nationkey AND nation.n_regionkey = 4; SELECT k, n, m FROM c", "SELECT c_custkey AS k, c_nationkey AS n, CASE WHEN n_regionkey = 2 THEN n_name ELSE c_mktsegment END AS m FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 4")
statement("dml_transaction", "CREATE TABLE n AS SELECT n_nationkey AS k, n_name AS name FROM nation; BEGIN; DELETE FROM n WHERE k > 20; SAVEPOINT a; TRUNCATE n; ROLLBACK TO a; UPDATE n SET name = 'zero' WHERE k = 0; COMMIT; BEGIN; DELETE FROM n; ROLLBACK; SELECT k, name FROM n", "SELECT n_nationkey AS k, CASE WHEN n_nationkey = 0 THEN 'zero' ELSE n_name END AS name FROM nation WHERE n_nationkey <= 20")
statement("ddl_alter", "CREATE TEMP TABLE n AS SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation; ALTER TABLE n ADD COLUMN z INT DEFAULT 4; ALTER TABLE n RENAME COLUMN name TO label; ALTER TABLE n DROP COLUMN r; CREATE SEQUENCE q START WITH 5 INCREMENT BY 2; SELECT k, label, z, nextval('q') AS s FROM n", "SELECT n_nationkey AS k, n_name AS label, 4 AS z, 5 AS s FROM nation")


# --- search predicates -------------------------------------------------------------------------------------------------------------


def scored(name: str, where: str, oracle: str | None, table: str = "documents", digits: int = 6) -> None:
    """The rows of a table that a predicate keeps, with their scores."""
    statement(name, f"SELECT {KEYS[table]} AS {ID}, {SCORE} FROM {table} WHERE {where}", oracle, digits)


_V1, _V3 = (f"ARRAY[{', '.join(map(repr, search._vec(k)))}]" for k in (1, 3))
scored("sql_text_match", f"text_match(text, '{QUERY}')", search.SQL["fts_bm25"])
scored("sql_bayesian_match", f"bayesian_match(text, '{QUERY}')", search.SQL["bayes_bm25"])
scored("sql_fuse_log_odds", f"fuse_log_odds(bayesian_match(text, '{QUERY}'), bayesian_match(text, '{OTHER}'))", search.SQL["fuse_log_odds"])
scored("sql_fuse_prob_and", f"fuse_prob_and(bayesian_match(text, '{QUERY}'), bayesian_match(text, '{OTHER}'))", search.SQL["fuse_prob_and"])
scored("sql_fuse_prob_or", f"fuse_prob_or(bayesian_match(text, '{QUERY}'), bayesian_match(text, '{OTHER}'))", search.SQL["fuse_prob_or"])
scored("sql_fuse_prob_not", f"fuse_prob_not(bayesian_match(text, '{QUERY}'))", search.SQL["fuse_prob_not"])
scored("sql_sparse_threshold", f"sparse_threshold(bayesian_match(text, '{QUERY}'), 0.6)", search.SQL["sparse_threshold"])
scored("sql_staged_retrieval", f"staged_retrieval(bayesian_match(text, '{QUERY}'), 100, bayesian_match(text, '{OTHER}'), 0.55)", search.SQL["staged_retrieval"])
scored("sql_knn_match", f"knn_match(embedding, {_V1}, 20)", search.SQL["knn"], "embeddings")
scored("sql_vector_exclude", f"vector_exclude(embedding, {_V1}, {_V3}, 50, 0.05)", search.SQL["vec_exclude"], "embeddings")
statement("sql_phrase", f"SELECT doc_id AS {ID}, {SCORE} FROM documents WHERE text @@ '\"the and\"'", search.SQL["fts_phrase"], 6)
statement("sql_match_join", f"SELECT l.doc_id, d.lang, l.quality, {SCORE} FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE text_match(d.text, '{QUERY}') AND l.quality = 1", f"WITH s AS ({search.SQL['fts_bm25']}) SELECT l.doc_id, d.lang, l.quality, s._score FROM labels l JOIN documents d ON d.doc_id = l.doc_id JOIN s ON s._doc_id = d.doc_id WHERE l.quality = 1", 6)
statement("sql_match_negated", f"SELECT doc_id, {SCORE} FROM documents WHERE lang = 'en' AND NOT text_match(text, '{QUERY}')", f"WITH s AS ({search.SQL['fts_bm25']}) SELECT doc_id, CAST(NULL AS DOUBLE) AS _score FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT _doc_id FROM s)", 6)
statement("sql_facets", f"SELECT facets(lang, source) FROM documents WHERE text_match(text, '{QUERY}')", search.SQL["fts_facets"])


@query("sql_spatial_within", search.SQL["spatial_within"])
def _(spark, sf_dir):
    s = session(spark, sf_dir)
    s.register("places", search._places(spark, sf_dir).select("c_custkey", F.array("lon", "lat").alias("at")), "c_custkey")
    return rounded(s.sql(f"SELECT c_custkey AS {ID}, {SCORE} FROM places WHERE spatial_within(at, POINT(11.0, 48.0), 3000000)"))


@query("sql_path_filter", search.SQL["path_filter"])
def _(spark, sf_dir):
    s = session(spark, sf_dir)
    s.register("nested", search._nested(spark, sf_dir), "o_orderkey")
    return s.sql("SELECT o_orderkey FROM nested WHERE path_filter('doc.lines.l_quantity', '>', 48.0)")


# --- graphs ------------------------------------------------------------------------------------------------------------------------


def _trade(spark: SparkSession, sf_dir: str) -> Session:
    s = session(spark, sf_dir)
    s.state.graphs["trade"] = search.trade_graph(spark, sf_dir)
    return s


@query("sql_traverse", search.SQL["graph_traverse"])
def _(spark, sf_dir):
    return _trade(spark, sf_dir).sql(f"SELECT id AS {ID}, {SCORE} FROM traverse(2000001, NULL, 3, 'trade')")


@query("sql_graph_neighbors", search.SQL["graph_neighbors"])
def _(spark, sf_dir):
    return _trade(spark, sf_dir).sql("SELECT id, depth FROM graph_neighbors('trade', 2000001, NULL, 'outgoing', 2)")


@query("sql_rpq", f"SELECT DISTINCT _doc_id, _score FROM ({search.SQL['graph_rpq_star']})")
def _(spark, sf_dir):
    return _trade(spark, sf_dir).sql(f"SELECT id AS {ID}, {SCORE} FROM rpq('(placed|supplied_by|in_nation)*', 2000001, 'trade')")


@query("sql_graph_edges", f"WITH {search._EDGES} SELECT src AS source_id, dst AS target_id, label FROM e WHERE label = 'in_region'")
def _(spark, sf_dir):
    return _trade(spark, sf_dir).sql("SELECT source_id, target_id, label FROM graph_edges('trade', 'in_region')")


statement("sql_graph_changes", "SELECT create_graph('g'); SELECT * FROM graph_create_node('g', 'person', '{\"name\": \"a\"}'); SELECT * FROM graph_create_node('g', 'person', '{\"name\": \"b\"}'); SELECT * FROM graph_create_node('g', 'city', '{\"name\": \"c\"}'); SELECT * FROM graph_create_edge('g', 'knows', 'g:person:1', 'g:person:2'); SELECT * FROM graph_create_edge('g', 'in', 'g:person:2', 'g:city:3'); SELECT * FROM graph_delete_node('g', 'g:person:1'); SELECT id, label, properties ->> 'name' AS name FROM graph_nodes('g')", "SELECT * FROM (VALUES (2::BIGINT, 'person', 'b'), (3::BIGINT, 'city', 'c')) AS t(id, label, name)")
statement("sql_grid_graph", "SELECT build_grid_graph('t', 3, 4, 'next'); SELECT source_id, target_id FROM graph_edges('t')", "SELECT r * 4 + c + 1 AS source_id, r * 4 + c + 2 AS target_id FROM range(3) a(r), range(3) b(c) UNION ALL SELECT r * 4 + c + 1, (r + 1) * 4 + c + 1 FROM range(2) a(r), range(4) b(c)")


def _cypher(name: str, text: str, columns: str, oracle: str) -> None:
    query(name, oracle)(lambda spark, sf_dir: _trade(spark, sf_dir).sql(f"SELECT * FROM cypher('trade', $$ {text} $$) AS ({columns})"))


_cypher("cypher_match", "MATCH (s:supplier)-[:in_nation]->(n:nation)-[:in_region]->(r:region) WHERE id(r) = 2 RETURN id(s) AS s, id(n) AS n", "s bigint, n bigint", "SELECT 1000000 + s_suppkey AS s, CAST(100 + n_nationkey AS BIGINT) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 2")
_cypher("cypher_optional", "MATCH (n:nation) OPTIONAL MATCH (n)<-[:in_nation]-(s:supplier) RETURN id(n) AS n, count(s) AS c", "n bigint, c bigint", "SELECT CAST(100 + n_nationkey AS BIGINT) AS n, count(s_suppkey) AS c FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
_cypher("cypher_variable_length", "MATCH (s:supplier)-[*1..2]->(x) RETURN DISTINCT id(x) AS x, labels(x)[0] AS l ORDER BY x", "x bigint, l string", "SELECT CAST(100 + n_nationkey AS BIGINT) AS x, 'nation' AS l FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier) UNION SELECT CAST(n_regionkey AS BIGINT), 'region' FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)")
_cypher("cypher_with", "MATCH (s:supplier)-[:in_nation]->(n:nation) WITH n, count(s) AS c WHERE c > 0 RETURN id(n) AS n, c ORDER BY c DESC, n SKIP 1 LIMIT 5", "n bigint, c bigint", "SELECT CAST(100 + s_nationkey AS BIGINT) AS n, count(*) AS c FROM supplier GROUP BY 1 HAVING count(*) > 0 ORDER BY 2 DESC, 1 LIMIT 5 OFFSET 1")
_cypher("cypher_unwind", "UNWIND range(1, 5) AS k WITH k WHERE k % 2 = 1 RETURN k, k * k AS q, CASE WHEN k > 2 THEN 'big' ELSE 'small' END AS size", "k bigint, q bigint, size string", "SELECT k, k * k AS q, CASE WHEN k > 2 THEN 'big' ELSE 'small' END AS size FROM range(1, 6, 2) t(k)")


# --- the fluent builder ----------------------------------------------------------------------------------------------------------


def _docs(spark, sf_dir):
    return session(spark, sf_dir).query("documents")


@query("api_bm25", search.SQL["fts_bm25"])
def _(spark, sf_dir):
    return rounded(_docs(spark, sf_dir).score_bm25(QUERY, "text").signal())


@query("api_and_filter", search.SQL["fts_bm25_filtered"])
def _(spark, sf_dir):
    return rounded(_docs(spark, sf_dir).score_bm25(QUERY, "text").filter("lang = 'en' AND n_chars > 500").execute().select("doc_id", "lang", SCORE))


@query("api_fuse_log_odds", search.SQL["fuse_log_odds"])
def _(spark, sf_dir):
    q = _docs(spark, sf_dir)
    two = [q.score_bayesian_bm25(x, "text").signal() for x in (QUERY, OTHER)]
    from dataclasses import replace

    return rounded(replace(q, current=two[0], held=tuple(two)).fuse_log_odds().signal())


@query("api_facet", search.SQL["fts_facets"])
def _(spark, sf_dir):
    return _docs(spark, sf_dir).term(QUERY, "text").facet("lang", "source")


@query("api_knn", search.SQL["knn"])
def _(spark, sf_dir):
    return rounded(session(spark, sf_dir).query("embeddings").knn(search._vec(1), 20, "embedding").signal())


@query("api_vector_facet", search.SQL["vec_facet"])
def _(spark, sf_dir):
    return session(spark, sf_dir).query("embeddings").vector_facet("embedding", search._vec(1), 0.0, "label")


@query("api_group_by", "SELECT c_mktsegment, round(avg(c_acctbal), 4) AS v FROM customer GROUP BY 1")
def _(spark, sf_dir):
    got = session(spark, sf_dir).query("customer").group_by("c_mktsegment", "c_acctbal", "avg")
    return rounded(got.toDF("c_mktsegment", "v"), 4)


@query("api_aggregate", "SELECT round(quantile_cont(c_acctbal, 0.25), 4) AS v FROM customer WHERE c_nationkey = 3")
def _(spark, sf_dir):
    got = session(spark, sf_dir).query("customer").filter("c_nationkey = 3").aggregate("c_acctbal", "quantile", 0.25)
    return rounded(got.toDF("v"), 4)


@query("api_path", f'SELECT "doc.status", "doc.lines.l_returnflag" FROM ({search.SQL["path_project"]})')
def _(spark, sf_dir):
    s = session(spark, sf_dir)
    s.register("nested", search._nested(spark, sf_dir), "o_orderkey")
    return s.query("nested").path_project("doc.status", "doc.lines.l_returnflag")


@query("api_set_operations", f"WITH {search.POSTINGS}, a AS (SELECT DISTINCT doc_id FROM p WHERE term = 'thanedble'), b AS (SELECT DISTINCT doc_id FROM p WHERE term = 'the') SELECT doc_id AS _doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM a UNION SELECT doc_id FROM b) AND doc_id NOT IN (SELECT doc_id FROM a INTERSECT SELECT doc_id FROM b)")
def _(spark, sf_dir):
    q = _docs(spark, sf_dir)
    a, b = q.term("thanedble", "text"), q.term("the", "text")
    return signals.intersect(a.or_(b).signal(), a.and_(b).not_().signal()).select(ID)
