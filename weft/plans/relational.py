"""Relational queries: filters, joins, aggregates, windows, set operations, subqueries and recursion, all planned by Catalyst.

Each entry is SQL that Spark runs as it stands; a second text is given where DuckDB spells the same query in another way.
"""

from __future__ import annotations

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_AGG = "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n"



def _nearest(c: str, digits: int) -> str:
    """A column rounded as SQL engines round doubles; see weft.functions.scalar.nearest."""
    m = f"{10.0**digits:.0f}D"
    z = f"signum({c} * {m}) * (rint(abs({c} * {m})) + CASE WHEN abs({c} * {m}) - rint(abs({c} * {m})) = 0.5D THEN 1 ELSE 0 END) / {m}"
    return f"CASE WHEN abs({z}) < double('inf') THEN {z} ELSE {c} END AS {c}"


#: name -> SQL, or (Spark's, DuckDB's).
SQL: dict[str, str | tuple[str, str]] = {
    # --- scans, filters, projections
    "scan_full": "SELECT * FROM nation",
    "scan_values": ("SELECT column1, column2 FROM VALUES (1, 'a'), (2, 'b'), (3, NULL) AS t(column1, column2)", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(column1, column2)"),
    "filter_basic": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 30 AND l_discount < 0.05 AND l_returnflag <> 'R'",
    "filter_between_in": "SELECT p_partkey, p_size, p_brand FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand IN ('Brand#1', 'Brand#12', 'Brand#23', 'Brand#34') OR p_size NOT BETWEEN 3 AND 47",
    "filter_like_ilike": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%1%' OR p_type ILIKE '%STEEL%' OR p_name NOT LIKE 'p%'",
    "filter_nulls": "SELECT o.o_orderkey, c.c_custkey FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 0 WHERE c.c_custkey IS NULL OR o.o_orderstatus IS NOT NULL AND NOT (c.c_acctbal < 100)",
    "filter_expression": "SELECT o_orderkey FROM orders WHERE o_totalprice * 2 > 100000 AND (o_orderkey + o_custkey) % 3 = 1",
    "filter_pushdown": "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1996-01-01 00:00:00' AND l_quantity < 24",
    "project_case_coalesce": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code, coalesce(nullif(o_orderstatus, 'O'), 'open') AS st, greatest(o_orderkey, o_custkey) AS g, least(o_orderkey, o_custkey) AS l FROM orders",
    "project_rename": "SELECT c_custkey AS id, c_name AS name, c_acctbal * 2 AS twice FROM customer",
    "cast_family": "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS qi, CAST(l_orderkey AS VARCHAR(20)) AS ks, CAST(CAST(l_linenumber AS VARCHAR(5)) AS BIGINT) AS lb, CAST(l_shipdate AS DATE) AS sd, CAST(l_linenumber AS DOUBLE) AS ld FROM lineitem",
    "arithmetic_null_div": ("SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_linenumber - 1, 0) AS q, CAST(floor(try_divide(l_orderkey, l_linenumber - 2)) AS BIGINT) AS fd, try_mod(l_orderkey, nullif(l_linenumber - 2, 0)) AS m FROM lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_linenumber - 1, 0) AS q, CAST(floor(l_orderkey / nullif(l_linenumber - 2, 0)) AS BIGINT) AS fd, l_orderkey % nullif(l_linenumber - 2, 0) AS m FROM lineitem"),
    "string_concat": "SELECT n_nationkey, n_name || '-' || CAST(n_regionkey AS VARCHAR(5)) AS label FROM nation",
    # --- joins
    "join_inner": "SELECT c.c_custkey, c.c_name, o.o_orderkey, o.o_totalprice FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey",
    "join_left": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 150000",
    "join_right": "SELECT c.c_custkey, o.o_orderkey FROM customer c RIGHT JOIN orders o ON c.c_custkey = o.o_custkey AND c.c_acctbal > 5000",
    "join_full": "SELECT c.c_custkey, s.s_suppkey FROM customer c FULL OUTER JOIN supplier s ON c.c_custkey = s.s_suppkey * 7",
    "join_cross": "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n",
    "join_implicit": "SELECT n.n_name, CAST(count(*) AS BIGINT) AS orders_n FROM customer c, orders o, nation n WHERE c.c_custkey = o.o_custkey AND c.c_nationkey = n.n_nationkey GROUP BY n.n_name",
    "join_theta": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_theta_left": "SELECT s.s_suppkey, r.r_regionkey FROM supplier s LEFT JOIN region r ON s.s_nationkey < r.r_regionkey",
    "join_natural_using": "SELECT n_regionkey, a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b USING (n_regionkey) WHERE a.n_nationkey <> b.n_nationkey",
    "join_multiway": "SELECT r.r_name, s.s_suppkey, CAST(count(*) AS BIGINT) AS lines, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name, s.s_suppkey",
    "join_semi": ("SELECT c_custkey, c_name FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000", "SELECT c_custkey, c_name FROM customer SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000"),
    "join_anti": ("SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000", "SELECT c_custkey FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey"),
    "join_sort_merge": ("SELECT /*+ MERGE(o) */ l_orderkey, l_linenumber, o_orderdate FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey", "SELECT l_orderkey, l_linenumber, o_orderdate FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"),
    "join_lateral": "SELECT c.c_custkey, t.top FROM customer c, LATERAL (SELECT max(o.o_totalprice) AS top FROM orders o WHERE o.o_custkey = c.c_custkey) t WHERE t.top IS NOT NULL",
    # --- aggregates
    "agg_basic": f"{_AGG}, sum(l_quantity) AS sum_qty, round(avg(l_extendedprice), 6) AS avg_price, min(l_discount) AS min_d, max(l_tax) AS max_t FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_global": "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(o_custkey) AS BIGINT) AS m, round(sum(o_totalprice), 2) AS s FROM orders WHERE o_orderkey < 0 OR o_totalprice > 0",
    "agg_distinct": "SELECT l_returnflag, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag",
    "agg_filter": "SELECT o_orderstatus, CAST(count(*) FILTER (WHERE o_totalprice > 100000) AS BIGINT) AS big, round(sum(o_totalprice) FILTER (WHERE o_orderpriority LIKE '1%'), 2) AS urgent FROM orders GROUP BY o_orderstatus",
    "agg_having": "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 8 AND sum(o_totalprice) > 500000",
    "agg_expr_key": "SELECT CAST(l_quantity / 10 AS INT) AS band, CAST(count(*) AS BIGINT) AS n FROM (SELECT floor(l_quantity / 10) * 10 AS l_quantity FROM lineitem) t GROUP BY CAST(l_quantity / 10 AS INT)",
    "agg_ordinal_alias": "SELECT o_orderpriority AS p, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1",
    "agg_string": ("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "agg_array": ("SELECT n_regionkey, sort_array(collect_list(n_name)) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, list(n_name ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "agg_bool": "SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS every_big, bool_or(o_totalprice > 400000) AS some_big FROM orders GROUP BY o_orderstatus",
    "agg_json_object": ("SELECT n_regionkey, to_json(map_from_entries(sort_array(collect_list(struct(n_name, n_nationkey))))) AS j FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(json_group_object(n_name, n_nationkey) AS VARCHAR) AS j FROM (SELECT * FROM nation ORDER BY n_name) GROUP BY n_regionkey"),
    "agg_stats": "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS ss, round(stddev_pop(l_quantity), 6) AS sp, round(var_samp(l_quantity), 6) AS vs, round(var_pop(l_quantity), 6) AS vp FROM lineitem GROUP BY l_returnflag",
    "agg_regr": "SELECT l_returnflag, round(corr(l_extendedprice, l_quantity), 6) AS r, round(covar_pop(l_extendedprice, l_quantity), 3) AS cp, round(covar_samp(l_extendedprice, l_quantity), 3) AS cs, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, round(regr_avgx(l_extendedprice, l_quantity), 6) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 4) AS ay, round(regr_sxx(l_extendedprice, l_quantity), 3) AS sxx, round(regr_sxy(l_extendedprice, l_quantity), 1) AS sxy, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS icept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY l_returnflag",
    "agg_percentile": "SELECT l_returnflag, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS med, percentile_disc(0.9) WITHIN GROUP (ORDER BY l_quantity) AS p90 FROM lineitem GROUP BY l_returnflag",
    "agg_mode": "SELECT p_brand, mode() WITHIN GROUP (ORDER BY w) AS m FROM (SELECT p_brand, CASE WHEN p_size < 30 THEN 'small' ELSE p_type END AS w FROM part) t GROUP BY p_brand",
    "agg_rollup": "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "agg_cube": "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_grouping_sets": "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "agg_facets": "SELECT facet_field, facet_value, CAST(count(*) AS BIGINT) AS facet_count FROM (SELECT 'lang' AS facet_field, lang AS facet_value FROM documents UNION ALL SELECT 'source', source FROM documents) t WHERE facet_value IS NOT NULL GROUP BY facet_field, facet_value",
    "agg_post_expression": "SELECT o_custkey, round(sum(o_totalprice) / count(*) + 1, 4) AS x, upper(min(o_orderpriority)) AS p FROM orders GROUP BY o_custkey",
    # --- windows
    "win_rank": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr FROM orders",
    "win_dist": "SELECT o_orderkey, round(percent_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey), 9) AS pr, round(cume_dist() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey), 9) AS cd FROM orders",
    "win_ntile": "SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS q FROM orders",
    "win_lag_lead": "SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev, lead(o_orderkey, 2, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt FROM orders",
    "win_first_last_nth": "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "win_rows": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s3, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS a3 FROM orders",
    # frames over equal values counted once: a window's partition has a row a value, not a row a line
    "win_range": ("WITH c AS (SELECT l_returnflag AS f, l_quantity AS q, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_quantity), w AS (SELECT f, q, sum(n) OVER (PARTITION BY f ORDER BY q RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM c) SELECT l_orderkey, l_linenumber, CAST(w.n AS BIGINT) AS n FROM lineitem JOIN w ON l_returnflag <=> w.f AND l_quantity <=> w.q", "SELECT l_orderkey, l_linenumber, CAST(count(*) OVER (PARTITION BY l_returnflag ORDER BY l_quantity RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS n FROM lineitem"),
    "win_default_frame": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority), 2) AS s FROM orders",
    "win_filter": ("SELECT o_orderkey, CAST(count(CASE WHEN o_totalprice > 100000 THEN 1 END) OVER (PARTITION BY o_custkey) AS BIGINT) AS n FROM orders", "SELECT o_orderkey, CAST(count(*) FILTER (WHERE o_totalprice > 100000) OVER (PARTITION BY o_custkey) AS BIGINT) AS n FROM orders"),
    "win_named": "SELECT o_orderkey, CAST(count(*) OVER w AS BIGINT) AS n, max(o_totalprice) OVER w AS m FROM orders WINDOW w AS (PARTITION BY o_custkey)",
    # sums in the order of keys, whatever the partitions: equal ones stay equal, so that ranks depend on the rows alone
    "win_over_aggregate": ("SELECT o_custkey, round(s, 2) AS s, rank() OVER (ORDER BY s DESC, o_custkey) AS r FROM (SELECT o_custkey, s FROM (SELECT o_custkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_totalprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s, lead(1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_totalprice) AS more FROM orders) t WHERE more IS NULL) t", "SELECT o_custkey, round(sum(o_totalprice), 2) AS s, rank() OVER (ORDER BY sum(o_totalprice) DESC, o_custkey) AS r FROM orders GROUP BY o_custkey"),
    "win_bool_string": ("SELECT n_nationkey, bool_or(n_nationkey > 20) OVER (PARTITION BY n_regionkey) AS b, concat_ws(',', collect_list(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)) AS names FROM nation", "SELECT n_nationkey, bool_or(n_nationkey > 20) OVER (PARTITION BY n_regionkey) AS b, string_agg(n_name, ',') OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS names FROM nation"),
    "win_qualify": ("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 2", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2"),
    # --- sort, limit, distinct, sets, subqueries
    "sort_nulls": "SELECT k, row_number() OVER (ORDER BY v ASC NULLS LAST, k) AS a, row_number() OVER (ORDER BY v DESC NULLS FIRST, k) AS d FROM (SELECT n_nationkey AS k, nullif(n_regionkey, 2) AS v FROM nation) t",
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "limit_offset": "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 5",
    "distinct": "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem",
    "union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "except": "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "cte": "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 150000) SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM big GROUP BY o_custkey",
    "cte_multi": "WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), b AS (SELECT avg(s) AS m FROM a) SELECT a.k, round(a.s, 2) AS s FROM a, b WHERE a.s > b.m",
    "cte_recursive_all": "WITH RECURSIVE t(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t",
    "in_subquery": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)",
    "not_in_subquery": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "exists_correlated": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 20)",
    "not_exists": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)",
    "scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)",
    "scalar_subquery_correlated": "SELECT c_custkey, (SELECT CAST(count(*) AS BIGINT) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c",
    "derived_table": "SELECT t.k, t.n FROM (SELECT o_custkey AS k, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey) t WHERE t.n > 5",
    "quantified_all": ("SELECT s_suppkey FROM supplier WHERE s_acctbal >= (SELECT max(c_acctbal) FROM customer WHERE c_acctbal < 5000) OR s_acctbal < (SELECT min(c_acctbal) FROM customer)", "SELECT s_suppkey FROM supplier WHERE s_acctbal >= ALL (SELECT c_acctbal FROM customer WHERE c_acctbal < 5000) OR s_acctbal < ALL (SELECT c_acctbal FROM customer)"),
    # --- scalar functions by family
    "fn_string": ("SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, char_length(p_name) AS n, trim(BOTH 'p' FROM p_name) AS t, replace(p_name, 'a', 'X') AS r, substring(p_name, 2, 3) AS s, concat_ws('/', p_brand, p_type) AS cw, left(p_name, 3) AS lf, right(p_name, 3) AS rt, translate(p_name, 'abc', 'xy') AS tr, ascii(p_name) AS a, position('a' IN p_name) AS po, octet_length(p_name) AS ol, md5(p_name) AS m, lpad(p_name, 5, '*') AS lp, rpad(p_name, 30, '-') AS rp, repeat(p_brand, 2) AS re, reverse(p_name) AS rv, split_part(p_type, ' ', 2) AS sp, startswith(p_name, 'p') AS st, overlay(p_name PLACING 'ZZ' FROM 2 FOR 1) AS ov FROM part", "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, CAST(length(p_name) AS INT) AS n, trim(p_name, 'p') AS t, replace(p_name, 'a', 'X') AS r, substring(p_name, 2, 3) AS s, concat_ws('/', p_brand, p_type) AS cw, left(p_name, 3) AS lf, right(p_name, 3) AS rt, translate(p_name, 'abc', 'xy') AS tr, ascii(p_name) AS a, CAST(position('a' IN p_name) AS INT) AS po, CAST(strlen(p_name) AS INT) AS ol, md5(p_name) AS m, lpad(p_name, 5, '*') AS lp, rpad(p_name, 30, '-') AS rp, repeat(p_brand, 2) AS re, reverse(p_name) AS rv, split_part(p_type, ' ', 2) AS sp, starts_with(p_name, 'p') AS st, substring(p_name, 1, 1) || 'ZZ' || substring(p_name, 3) AS ov FROM part"),
    "fn_regex": ("SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '_') AS r, regexp_extract(p_brand, '([0-9]+)', 1) AS d, regexp_like(p_name, '^p') AS m, split(p_type, ' ') AS parts FROM part", "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '_', 'g') AS r, regexp_extract(p_brand, '([0-9]+)', 1) AS d, regexp_matches(p_name, '^p') AS m, string_split(p_type, ' ') AS parts FROM part"),
    "fn_math": (f"SELECT o_orderkey, a, {_nearest('sq', 6)}, c, f, {_nearest('p', 3)}, {_nearest('ln', 6)}, {_nearest('lg', 6)}, {_nearest('e', 6)}, m, sg, {_nearest('cb', 6)}, {_nearest('pi', 9)} FROM (SELECT o_orderkey, abs(-o_totalprice) AS a, sqrt(o_totalprice) AS sq, ceil(o_totalprice) AS c, floor(o_totalprice) AS f, power(o_custkey, 2) AS p, ln(o_totalprice) AS ln, log10(o_totalprice) AS lg, weft_exp(CAST(o_custkey / 1000.0 AS DOUBLE)) AS e, o_orderkey % 7 AS m, CAST(sign(o_custkey - 50) AS INT) AS sg, cbrt(o_totalprice) AS cb, pi() AS pi FROM orders)", "SELECT o_orderkey, abs(-o_totalprice) AS a, round(sqrt(o_totalprice), 6) AS sq, CAST(ceil(o_totalprice) AS BIGINT) AS c, CAST(floor(o_totalprice) AS BIGINT) AS f, round(power(o_custkey, 2), 3) AS p, round(ln(o_totalprice), 6) AS ln, round(log10(o_totalprice), 6) AS lg, round(exp(CAST(o_custkey AS DOUBLE) / 1000.0), 6) AS e, o_orderkey % 7 AS m, CAST(sign(o_custkey - 50) AS INT) AS sg, round(cbrt(o_totalprice), 6) AS cb, round(pi(), 9) AS pi FROM orders"),
    "fn_trig": "SELECT n_nationkey, round(sin(n_nationkey), 8) AS s, round(cos(n_nationkey), 8) AS c, round(tan(n_nationkey), 6) AS t, round(asin(CAST(n_nationkey AS DOUBLE) / 30), 8) AS asn, round(acos(CAST(n_nationkey AS DOUBLE) / 30), 8) AS acs, round(atan(n_nationkey), 8) AS atn, round(atan2(n_nationkey, 3), 8) AS a2, round(degrees(n_nationkey), 6) AS d, round(radians(n_nationkey), 8) AS r FROM nation",
    "fn_datetime": ("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, hour(o_orderdate) AS h, dayofweek(o_orderdate) - 1 AS dow, dayofyear(o_orderdate) AS doy, quarter(o_orderdate) AS q, weekofyear(o_orderdate) AS w, unix_timestamp(o_orderdate) AS ep, date_trunc('month', o_orderdate) AS mt, make_date(year(o_orderdate), 1, 1) AS jan, datediff(DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS dd, date_format(o_orderdate, 'yyyy-MM-dd') AS f FROM orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(hour(o_orderdate) AS INT) AS h, CAST(dayofweek(o_orderdate) AS INT) AS dow, CAST(dayofyear(o_orderdate) AS INT) AS doy, CAST(quarter(o_orderdate) AS INT) AS q, CAST(weekofyear(o_orderdate) AS INT) AS w, CAST(epoch(o_orderdate) AS BIGINT) AS ep, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS mt, make_date(year(o_orderdate), 1, 1) AS jan, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS INT) AS dd, strftime(o_orderdate, '%Y-%m-%d') AS f FROM orders"),
    "fn_json": ("SELECT event_id, get_json_object(props, '$.k') AS k, json_object_keys(props) AS keys FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_keys(props) AS keys FROM events"),
    "fn_array": ("SELECT vec_id, size(embedding) AS n, array_append(embedding, 0.5F) AS a, array_remove(array(1, 2, vec_id % 3), 1) AS r, array_contains(array(1, 2, 3), label) AS c, concat(array(1), array(label)) AS cat FROM embeddings", "SELECT vec_id, CAST(len(embedding) AS INT) AS n, list_append(embedding, CAST(0.5 AS FLOAT)) AS a, list_filter([1, 2, vec_id % 3], lambda x: x <> 1) AS r, list_contains([1, 2, 3], label) AS c, list_concat([1], [label]) AS cat FROM embeddings"),
    "fn_encode": ("SELECT n_nationkey, base64(encode(n_name, 'UTF-8')) AS b, lower(hex(n_name)) AS h, decode(unbase64(base64(encode(n_name, 'UTF-8'))), 'UTF-8') AS back FROM nation", "SELECT n_nationkey, to_base64(encode(n_name)) AS b, lower(hex(encode(n_name))) AS h, n_name AS back FROM nation"),
    # --- table functions
    "tf_generate_series": ("SELECT id AS n FROM range(3, 40, 4)", "SELECT CAST(generate_series AS BIGINT) AS n FROM generate_series(3, 39, 4)"),
    "tf_unnest": ("SELECT vec_id, pos, e FROM embeddings LATERAL VIEW posexplode(embedding) t AS pos, e", "SELECT vec_id, CAST(i - 1 AS INT) AS pos, embedding[i] AS e FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) t"),
    "tf_regexp_split": ("SELECT p_partkey, w FROM part LATERAL VIEW explode(split(p_type, ' +')) t AS w", "SELECT p_partkey, unnest(string_split_regex(p_type, ' +')) AS w FROM part"),
    "tf_json_each": ("SELECT event_id, t.key, t.value FROM (SELECT event_id, props FROM events) e LATERAL VIEW explode(from_json(props, 'map<string,string>')) t AS key, value", "SELECT event_id, j.key AS key, json_extract_string(props, '$.' || j.key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events) j"),
    # --- TPC-H shaped reports
    "report_pricing": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, round(avg(l_discount), 6) AS d, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "report_revenue": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.03 AND 0.08 AND l_quantity < 24",
    "report_top_orders": "SELECT o.o_orderkey, o.o_orderdate, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE c.c_mktsegment = 'BUILDING' GROUP BY o.o_orderkey, o.o_orderdate ORDER BY revenue DESC, o.o_orderkey LIMIT 10",
    "stream_tumbling": ("SELECT window.start AS w, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS s FROM events GROUP BY window(ts, '1 hour'), event_type", "SELECT date_trunc('hour', ts) AS w, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS s FROM events GROUP BY 1, 2"),
    "stream_session": "WITH x AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL '30' MINUTE THEN 0 ELSE 1 END AS fresh FROM events), y AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM x) SELECT user_id, min(ts) AS a, max(ts) AS b, CAST(count(*) AS BIGINT) AS n FROM y GROUP BY user_id, s",
}


def spark_sql(name: str) -> str:
    return SQL[name] if isinstance(SQL[name], str) else SQL[name][0]


def oracle(name: str) -> str:
    return SQL[name] if isinstance(SQL[name], str) else SQL[name][1]
