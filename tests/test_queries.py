"""A sample of the registered queries against their SQL; the whole list is compared at a larger size by the driver."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from weft import plans
from weft.plans import relational

AT = "/root/testdata/sf0.001"
NAMES = ["filter_like_ilike", "project_case_coalesce", "arithmetic_null_div", "join_full", "join_theta_left", "agg_filter", "agg_regr", "agg_cube", "win_range", "win_filter", "sort_nulls", "except_all", "cte_recursive_all", "fn_string", "fn_datetime", "tf_json_each", "fts_bm25", "fts_and_or_not", "fuse_log_odds", "knn", "spatial_within", "path_filter", "graph_traverse", "graph_pattern", "stream_session", "graph_hits", "session_regexp", "session_json", "session_window_filter", "dml_upsert", "sql_fuse_log_odds", "sql_match_join", "cypher_optional", "api_knn"]


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in relational.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{AT}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    df = plans.queries()[name](spark, AT)
    columns = sorted(df.columns)
    mine = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    r = duck.execute(plans.oracle_sql()[name])
    names = [d[0] for d in r.description]
    theirs = sorted(str([plain(row[names.index(c)]) for c in columns]) for row in r.fetchall())
    assert sorted(names) == columns and mine == theirs


def test_registry(spark):
    assert set(plans.oracle_sql()) <= set(plans.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_filters_reach_the_scan(spark):
    plan = plans.queries()["filter_pushdown"](spark, AT)._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(l_shipdate" in plan and "l_comment" not in plan


def test_imports_without_the_subpackage(tmp_path):
    root = Path(entry.__file__).parent
    subprocess.run(["cp", "-r", str(root / "weft"), str(root / "__spark_entry__.py"), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "weft" / "llm")], check=True)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith(('op', 'pipeline')) for q in e.queries()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.stdout.split()[1:] == ["False"], out.stderr


def own_rows(spark, duck, tmp_path, name, table, select):
    """A query and its SQL over a table that DuckDB makes, values exact; the dataframe too."""
    at = tmp_path / name
    at.mkdir()
    for t in relational.TABLES:
        (at / f"{t}.parquet").symlink_to(f"{AT}/{t}.parquet")
    (at / f"{table}.parquet").unlink()
    duck.execute(f"COPY ({select}) TO '{at}/{table}.parquet' (ROW_GROUP_SIZE 2048)")
    own = duckdb.connect(config={"threads": 1})
    own.execute(f"SET TimeZone='UTC'; CREATE VIEW {table} AS SELECT * FROM '{at}/{table}.parquet'")
    df = plans.queries()[name](spark, str(at))
    r = own.execute(plans.oracle_sql()[name])
    names = [d[0] for d in r.description]
    theirs = sorted(str(row) for row in r.fetchall())
    return sorted(str(tuple(x[c] for c in names)) for x in df.collect()), theirs, df


@pytest.mark.parametrize("name", ["fn_math", "session_rounding"])
def test_large_keys_have_the_values_of_sql(spark, duck, tmp_path, name):
    # keys whose exponentials round at their sixth digit, have last bits of their own, or are infinite
    mine, theirs, _ = own_rows(spark, duck, tmp_path, name, "orders", f"SELECT o.* REPLACE (k AS o_orderkey, (CASE WHEN k < 3000 THEN 12000 + k ELSE k * 237 END)::BIGINT AS o_custkey) FROM range(1, 6000) t(k), (SELECT * FROM '{AT}/orders.parquet' LIMIT 1) o")
    assert mine == theirs and any("inf" in x for x in mine)


def test_ranks_of_equal_sums(spark, duck, tmp_path, monkeypatch):
    # copies of customers, whose orders are cut into partitions in other places
    monkeypatch.setattr(plans, "views", lambda s, d, sql: s.read.parquet(f"{d}/orders.parquet").repartition(7, F.xxhash64("o_orderkey")).createOrReplaceTempView("orders"))
    mine, theirs, _ = own_rows(spark, duck, tmp_path, "win_over_aggregate", "orders", f"SELECT o.* REPLACE (o_orderkey + k * 1000000 AS o_orderkey, o_custkey + k * 1000000 AS o_custkey) FROM range(40) t(k), '{AT}/orders.parquet' o ORDER BY k, o_orderkey")
    assert mine == theirs


def test_frames_of_few_partitions(spark, duck, tmp_path):
    mine, theirs, df = own_rows(spark, duck, tmp_path, "win_range", "lineitem", f"SELECT l.* REPLACE (CASE l_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN l_quantity + 0.5 WHEN 2 THEN 'nan'::DOUBLE ELSE l_quantity END AS l_quantity, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag) FROM '{AT}/lineitem.parquet' l")
    assert mine == theirs
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Window") :]
