"""Queries over signals: text, vectors, fusion, places, nested records and graphs, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import scalar
from weft.operators import deep, fusion, graph, nested, signals, spatial, text, vector
from weft.operators.graph import EdgePattern, Graph
from weft.operators.signals import ID, SCORE

QUERY, OTHER = "the thanedble anea", "tionnt onerinst der"
SQL: dict[str, str] = {}
RUN: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f):
        RUN[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(scalar.nearest(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# --- text ----------------------------------------------------------------------------------------------------------------


def _index(spark, sf_dir):
    return text.index(table(spark, sf_dir, "documents"), "doc_id", ["text"], "plain")


def _terms(q: str) -> str:
    return ", ".join(f"'{t}'" for t in sorted(set(q.split())))


POSTINGS = "t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), d AS (SELECT doc_id, count(*) AS dl FROM t GROUP BY 1), c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d)"


def _m(q: str, name: str = "m") -> str:
    """A CTE of the query's postings with idf and BM25 score s of each."""
    return f"f{name} AS (SELECT term, count(*) AS df FROM p WHERE term IN ({_terms(q)}) GROUP BY 1), w{name} AS (SELECT p.doc_id, p.term, p.tf, d.dl, c.avgdl, ln((c.n - f.df + 0.5) / (f.df + 0.5) + 1) AS w FROM p JOIN f{name} f USING (term) JOIN d USING (doc_id), c), {name} AS (SELECT *, w - w / (1 + tf / (1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS s FROM w{name})"


def _logit(x: str) -> str:
    return f"ln(({_clip(x)}) / (1 - {_clip(x)}))"


def _clip(x: str) -> str:
    return f"least(greatest({x}, 1e-15), 1 - 1e-15)"


def _sig(x: str) -> str:
    return f"(1 / (1 + exp(-({x}))))"


_PRIOR = "least(0.9, greatest(0.1, 0.7 * (0.2 + 0.7 * least(1.0, tf / 10)) + 0.3 * (0.3 + 0.6 * (1 - least(1.0, abs(dl / avgdl - 0.5) * 2)))))"


def _bayes(q: str, name: str) -> str:
    return f"{_m(q, 'm' + name)}, {name} AS (SELECT doc_id, {_sig(f'avg({_logit(_sig("s"))} + {_logit(_PRIOR)})')} AS p FROM m{name} GROUP BY 1)"


@query("fts_term", f"WITH {POSTINGS} SELECT doc_id AS _doc_id, CAST(sum(tf) AS DOUBLE) AS _score FROM p WHERE term IN ({_terms(QUERY)}) GROUP BY 1")
def _(spark, sf_dir):
    return text.term(_index(spark, sf_dir), QUERY)


@query("fts_bm25", f"WITH {POSTINGS}, {_m(QUERY)} SELECT doc_id AS _doc_id, round(sum(s), 6) AS _score FROM m GROUP BY 1")
def _(spark, sf_dir):
    return rounded(text.bm25(_index(spark, sf_dir), QUERY))


@query("fts_bm25_topk", f"WITH {POSTINGS}, {_m(QUERY)} SELECT doc_id AS _doc_id, round(sum(s), 6) AS _score FROM m GROUP BY 1 ORDER BY sum(s) DESC, doc_id LIMIT 10")
def _(spark, sf_dir):
    return rounded(signals.top_k(text.bm25(_index(spark, sf_dir), QUERY), 10))


@query("fts_bm25_filtered", f"WITH {POSTINGS}, {_m(QUERY)} SELECT m.doc_id, lang, round(sum(s), 6) AS _score FROM m JOIN documents USING (doc_id) WHERE lang = 'en' AND n_chars > 500 GROUP BY 1, 2")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return rounded(signals.attach(docs.where("lang = 'en' AND n_chars > 500"), text.bm25(_index(spark, sf_dir), QUERY), "doc_id").select("doc_id", "lang", SCORE))


@query("fts_and_or_not", f"WITH {POSTINGS}, {_m('thanedble', 'a')}, {_m('the', 'b')}, sa AS (SELECT doc_id, sum(s) AS s FROM a GROUP BY 1), sb AS (SELECT doc_id, sum(s) AS s FROM b GROUP BY 1), o AS (SELECT doc_id, sum(s) AS s FROM (SELECT * FROM sa UNION ALL SELECT * FROM sb) GROUP BY 1) SELECT 'and' AS op, doc_id AS _doc_id, round(sa.s + sb.s, 6) AS _score FROM sa JOIN sb USING (doc_id) UNION ALL SELECT 'or', doc_id, round(s, 6) FROM o UNION ALL SELECT 'not', doc_id, 0.0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM sa) UNION ALL SELECT 'minus', doc_id, round(s, 6) FROM sb WHERE doc_id NOT IN (SELECT doc_id FROM sa)")
def _(spark, sf_dir):
    ix = _index(spark, sf_dir)
    a, b = text.bm25(ix, "thanedble"), text.bm25(ix, "the")
    universe = signals.signal(table(spark, sf_dir, "documents"), "doc_id")
    out = [("and", signals.intersect(a, b)), ("or", signals.union(a, b)), ("not", signals.complement(a, universe)), ("minus", signals.difference(b, a))]
    parts = [rounded(s).select(F.lit(op).alias("op"), ID, SCORE) for op, s in out]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("fts_phrase", f"WITH {POSTINGS}, {_bayes('the and', 'b')} SELECT doc_id AS _doc_id, round(p, 6) AS _score FROM b WHERE doc_id IN (SELECT doc_id FROM mb GROUP BY 1 HAVING count(DISTINCT term) = 2)")
def _(spark, sf_dir):
    return rounded(text.phrase(_index(spark, sf_dir), "the and"))


@query("fts_facets", f"WITH {POSTINGS}, h AS (SELECT DISTINCT doc_id FROM p WHERE term IN ({_terms(QUERY)})), r AS (SELECT documents.* FROM documents JOIN h USING (doc_id)) SELECT 'lang' AS facet_field, lang AS facet_value, CAST(count(*) AS BIGINT) AS facet_count FROM r WHERE lang IS NOT NULL GROUP BY 2 UNION ALL SELECT 'source', source, CAST(count(*) AS BIGINT) FROM r WHERE source IS NOT NULL GROUP BY 2")
def _(spark, sf_dir):
    return signals.facets(signals.attach(table(spark, sf_dir, "documents"), text.term(_index(spark, sf_dir), QUERY), "doc_id"), "lang", "source")


@query("fts_bm25_multi", f"WITH {POSTINGS.replace('lower(text)', 'lower(text)')}, {_bayes(QUERY, 'x')}, t2 AS (SELECT doc_id, unnest(regexp_extract_all(lower(source), '[a-z0-9_]+')) AS term FROM documents), y AS (SELECT doc_id, count(*) AS tf FROM t2 WHERE term = 'src1' GROUP BY 1) SELECT doc_id AS _doc_id, round({_sig(f'0.5 * {_logit("coalesce(p, 0.5)")} + 0.5 * {_logit("0.5")}')}, 6) AS _score FROM x")
def _(spark, sf_dir):
    ix = text.index(table(spark, sf_dir, "documents"), "doc_id", ["text", "source"], "plain")
    return rounded(text.multi_field(ix, QUERY, ["text", "source"]))


@query("bayes_bm25", f"WITH {POSTINGS}, {_bayes(QUERY, 'b')} SELECT doc_id AS _doc_id, round(p, 6) AS _score FROM b")
def _(spark, sf_dir):
    return rounded(text.bayesian(_index(spark, sf_dir), QUERY))


@query("bayes_prior", f"WITH {POSTINGS}, {_bayes(QUERY, 'b')} SELECT doc_id AS _doc_id, round({_sig(f'{_logit("p")} + {_logit("CASE WHEN quality = 1 THEN 0.8 ELSE 0.4 END")}')}, 6) AS _score FROM b JOIN labels USING (doc_id)")
def _(spark, sf_dir):
    level = F.when(F.col("quality") == 1, "high").otherwise("low")
    return rounded(text.with_prior(text.bayesian(_index(spark, sf_dir), QUERY), table(spark, sf_dir, "labels"), "doc_id", text.authority_prior(level)))


@query("analyzer_standard")
def _(spark, sf_dir):
    from weft.functions import analysis

    return table(spark, sf_dir, "documents").select("doc_id", analysis.column("standard")(F.col("text")).alias("tokens"))


@query("highlight")
def _(spark, sf_dir):
    from weft.functions import analysis

    return table(spark, sf_dir, "documents").select("doc_id", analysis.highlighted(F.col("text"), QUERY.split(), "plain", size=120, most=2).alias("text"))


# --- fusion ----------------------------------------------------------------------------------------------------------------


def _two(spark, sf_dir):
    ix = _index(spark, sf_dir)
    text.prepare(ix, ix.terms(QUERY) + ix.terms(OTHER))
    return [text.bayesian(ix, QUERY), text.bayesian(ix, OTHER)]


_TWO = f"WITH {POSTINGS}, {_bayes(QUERY, 'a')}, {_bayes(OTHER, 'b')}, j AS (SELECT doc_id, a.p AS pa, b.p AS pb FROM a FULL JOIN b USING (doc_id)), k AS (SELECT count(*) AS n, count(pa) AS na, count(pb) AS nb FROM j), u AS (SELECT doc_id, coalesce(pa, 0.5 * (1 - na / n) + 0.01 * (na / n)) AS pa, coalesce(pb, 0.5 * (1 - nb / n) + 0.01 * (nb / n)) AS pb FROM j, k)"


def _fused(expression: str) -> str:
    return f"{_TWO} SELECT doc_id AS _doc_id, round({expression}, 6) AS _score FROM u"


@query("fuse_log_odds", _fused(_sig(f"sqrt(2.0) * ({_logit('pa')} + {_logit('pb')}) / 2")))
def _(spark, sf_dir):
    return rounded(fusion.log_odds(_two(spark, sf_dir)))


@query("fuse_mean", _fused(_sig(f"({_logit('pa')} + {_logit('pb')}) / 2")))
def _(spark, sf_dir):
    return rounded(fusion.log_odds(_two(spark, sf_dir), alpha=0.0))


@query("fuse_weighted", _fused(_sig(f"0.75 * {_logit('pa')} + 0.25 * {_logit('pb')}")))
def _(spark, sf_dir):
    return rounded(fusion.log_odds(_two(spark, sf_dir), weights=[3.0, 1.0]))


@query("fuse_gated", _fused(_sig(f"sqrt(2.0) * (greatest({_logit('pa')}, 0) + greatest({_logit('pb')}, 0)) / 2")))
def _(spark, sf_dir):
    return rounded(fusion.log_odds(_two(spark, sf_dir), gating="relu"))


@query("fuse_prob_and", _fused("pa * pb"))
def _(spark, sf_dir):
    return rounded(fusion.prob_and(_two(spark, sf_dir)))


@query("fuse_prob_or", _fused("1 - (1 - pa) * (1 - pb)"))
def _(spark, sf_dir):
    return rounded(fusion.prob_or(_two(spark, sf_dir)))


@query("fuse_prob_not", f"WITH {POSTINGS}, {_bayes(QUERY, 'a')} SELECT doc_id AS _doc_id, round(1 - coalesce(p, 0.01), 6) AS _score FROM documents LEFT JOIN a USING (doc_id)")
def _(spark, sf_dir):
    return rounded(fusion.prob_not(_two(spark, sf_dir)[0], signals.signal(table(spark, sf_dir, "documents"), "doc_id")))


@query("fuse_attention", _fused(_sig(f"sqrt(2.0) * ({_logit('pa')} + {_logit('pb')}) / 2")))
def _(spark, sf_dir):
    return rounded(fusion.attention(_two(spark, sf_dir), [0.0] * 6))


@query("fuse_adaptive")
def _(spark, sf_dir):
    return rounded(fusion.adaptive(_two(spark, sf_dir)))


@query("fuse_learned")
def _(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias(ID), F.col("quality").alias("label"))
    two = _two(spark, sf_dir)
    return rounded(fusion.Learned(2).fit(two, labels, rounds=5).fuse(two))


@query("sparse_threshold", f"WITH {POSTINGS}, {_bayes(QUERY, 'a')} SELECT doc_id AS _doc_id, round(p - 0.6, 6) AS _score FROM a WHERE p > 0.6")
def _(spark, sf_dir):
    return rounded(signals.threshold(_two(spark, sf_dir)[0], 0.6))


@query("staged_retrieval", f"WITH {POSTINGS}, {_bayes(QUERY, 'a')}, {_bayes(OTHER, 'b')}, s1 AS (SELECT doc_id, p FROM a ORDER BY p DESC, doc_id LIMIT 100) SELECT doc_id AS _doc_id, round(coalesce(b.p, s1.p), 6) AS _score FROM s1 LEFT JOIN b USING (doc_id) WHERE coalesce(b.p, s1.p) >= 0.55")
def _(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return rounded(signals.staged(a, (None, 100), (b, 0.55)))


@query("progressive_fusion")
def _(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return rounded(fusion.progressive([([a], 200), ([b], 50)]))


# --- calibration -------------------------------------------------------------------------------------------------------------

_SCORED = "SELECT (n_chars % 997) / 997.0 AS p, quality FROM documents JOIN labels USING (doc_id)"


def _scored(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(((F.col("n_chars") % 997) / 997.0).alias("p"), "quality")


@query("calib_reliability", f"WITH x AS (SELECT CAST(p AS DOUBLE) AS p, quality FROM ({_SCORED})) SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS confidence, round(avg(quality), 6) AS accuracy FROM x GROUP BY 1")
def _(spark, sf_dir):
    return rounded(text.calibration(_scored(spark, sf_dir), "p", "quality")).select("bin", "n", "confidence", "accuracy")


@query("calib_report", f"WITH x AS (SELECT CAST(p AS DOUBLE) AS p, CAST(quality AS DOUBLE) AS y, least(greatest(CAST(p AS DOUBLE), 1e-15), 1 - 1e-15) AS q FROM ({_SCORED})), b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS c, avg(y) AS a FROM x GROUP BY 1) SELECT count(*) AS n, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier, round((SELECT sum(n * abs(c - a)) / sum(n) FROM b), 6) AS ece FROM x")
def _(spark, sf_dir):
    return rounded(text.calibration_report(_scored(spark, sf_dir), "p", "quality"))


# --- vectors -----------------------------------------------------------------------------------------------------------------


def _vec(seed: int) -> list[float]:
    return [((i * 37 + seed * 11) % 17) / 17 - 0.5 for i in range(64)]


def _cos(q: list[float], col: str = "embedding") -> str:
    return f"list_cosine_similarity(CAST({col} AS DOUBLE[]), [{', '.join(map(repr, q))}])"


@query("knn", f"SELECT vec_id AS _doc_id, round({_cos(_vec(1))}, 6) AS _score FROM embeddings ORDER BY {_cos(_vec(1))} DESC, vec_id LIMIT 20")
def _(spark, sf_dir):
    return rounded(vector.knn(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _vec(1), 20))


@query("vec_threshold", f"SELECT vec_id AS _doc_id, round({_cos(_vec(1))}, 6) AS _score FROM embeddings WHERE {_cos(_vec(1))} >= 0.1")
def _(spark, sf_dir):
    return rounded(vector.within(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _vec(1), 0.1))


@query("vec_probability", f"SELECT vec_id AS _doc_id, round((1 + {_cos(_vec(2))}) / 2, 6) AS _score FROM embeddings")
def _(spark, sf_dir):
    return rounded(vector.probability(vector.similarities(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _vec(2))))


@query("vec_exclude", f"WITH k AS (SELECT * FROM embeddings ORDER BY {_cos(_vec(1))} DESC, vec_id LIMIT 50) SELECT vec_id AS _doc_id, round({_cos(_vec(1))}, 6) AS _score FROM k WHERE {_cos(_vec(3))} < 0.05")
def _(spark, sf_dir):
    return rounded(vector.exclude(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _vec(1), _vec(3), 50, 0.05))


@query("vec_facet", f"SELECT 'label' AS facet_field, CAST(label AS VARCHAR) AS facet_value, count(*) AS facet_count FROM embeddings WHERE {_cos(_vec(1))} >= 0.0 GROUP BY 2")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return signals.facets(signals.attach(e, vector.within(e, "vec_id", "embedding", _vec(1), 0.0), "vec_id"), "label")


@query("vec_join", "SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS _score FROM embeddings a, embeddings b WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.4")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return rounded(vector.join(e, e, ("vec_id", "embedding"), ("vec_id", "embedding"), 0.4))


@query("hybrid_join", "SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS _score FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.4")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return rounded(vector.join(e, e, ("vec_id", "embedding"), ("vec_id", "embedding"), 0.4, [("label", "label")]))


@query("knn_calibrated")
def _(spark, sf_dir):
    return rounded(vector.calibrated(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _vec(1), 25))


@query("knn_ivf")
def _(spark, sf_dir):
    return rounded(vector.IVF(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, 3).search(_vec(1), 10, 3))


@query("hybrid_text_vector", f"WITH {POSTINGS}, {_m(QUERY)}, b AS (SELECT doc_id, sum(s) AS s FROM m GROUP BY 1) SELECT doc_id AS _doc_id, round(s + {_cos(_vec(1))}, 6) AS _score FROM b JOIN embeddings ON vec_id = doc_id WHERE {_cos(_vec(1))} >= 0.05")
def _(spark, sf_dir):
    return rounded(vector.hybrid(text.bm25(_index(spark, sf_dir), QUERY), table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _vec(1), 0.05))


# --- places and nested records -------------------------------------------------------------------------------------------------

_PLACES = "(SELECT c_custkey, CAST(c_custkey * 37 % 360 - 180 AS DOUBLE) AS lon, CAST(c_custkey * 17 % 180 - 90 AS DOUBLE) AS lat FROM customer)"
_HAVERSINE = "2 * 6371000 * asin(sqrt(least(1.0, power(sin(radians(48.0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(48.0)) * power(sin(radians(11.0 - lon) / 2), 2))))"


def _places(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k, (k * 37 % 360 - 180).cast("double").alias("lon"), (k * 17 % 180 - 90).cast("double").alias("lat"))


@query("st_distance", f"SELECT c_custkey, round({_HAVERSINE}, 2) AS metres FROM {_PLACES}")
def _(spark, sf_dir):
    return rounded(_places(spark, sf_dir).select("c_custkey", spatial.distance(F.col("lon"), F.col("lat"), F.lit(11.0), F.lit(48.0)).alias("metres")), 2)


@query("spatial_within", f"SELECT c_custkey AS _doc_id, round(1 - m / 3000000, 6) AS _score FROM (SELECT c_custkey, {_HAVERSINE} AS m FROM {_PLACES}) WHERE m <= 3000000")
def _(spark, sf_dir):
    return rounded(spatial.within(_places(spark, sf_dir), "c_custkey", "lon", "lat", (11.0, 48.0), 3_000_000))


def _nested(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag"))).alias("lines"))
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), "lines").alias("doc"))


@query("path_filter", "SELECT DISTINCT o_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 48")
def _(spark, sf_dir):
    return nested.path_filter(_nested(spark, sf_dir), "doc.lines.l_quantity", 48.0, ">").select("o_orderkey")


@query("path_project", "SELECT o_orderkey, o_orderstatus AS \"doc.status\", list(l_returnflag ORDER BY l_linenumber, l_quantity, l_returnflag) AS \"doc.lines.l_returnflag\" FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2")
def _(spark, sf_dir):
    return nested.path_project(_nested(spark, sf_dir), "o_orderkey", "doc.status", "doc.lines.l_returnflag")


@query("path_unnest", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag) - 1 AS INT) AS _unnest_index, l_quantity AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def _(spark, sf_dir):
    return nested.path_unnest(_nested(spark, sf_dir), "doc.lines").select("o_orderkey", "_unnest_index", F.col("element.l_quantity").alias("q"))


@query("path_agg", "SELECT o_orderkey, sum(l_quantity) AS s, CAST(count(*) AS INT) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_quantity), 6) AS a FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def _(spark, sf_dir):
    d, p = _nested(spark, sf_dir), "doc.lines.l_quantity"
    for how, name in (("sum", "s"), ("count", "n"), ("min", "lo"), ("max", "hi"), ("avg", "a")):
        d = nested.path_aggregate(d, p, how, name)
    return rounded(d.select("o_orderkey", "s", "n", "lo", "hi", "a"))


# --- graphs --------------------------------------------------------------------------------------------------------------------

#: Ids: region 0.., nation 100.., supplier 1,000,000.., customer 2,000,000.., order 10,000,000.., part 5,000,000,000..
_EDGES = "e AS (SELECT 2000000 + c_custkey AS src, 100 + c_nationkey AS dst, 'in_nation' AS label FROM customer UNION ALL SELECT 1000000 + s_suppkey, 100 + s_nationkey, 'in_nation' FROM supplier UNION ALL SELECT 100 + n_nationkey, n_regionkey, 'in_region' FROM nation UNION ALL SELECT 2000000 + o_custkey, 10000000 + o_orderkey, 'placed' FROM orders UNION ALL SELECT DISTINCT 10000000 + l_orderkey, 1000000 + l_suppkey, 'supplied_by' FROM lineitem)"


def trade_graph(spark: SparkSession, sf_dir: str) -> Graph:
    t = lambda n: table(spark, sf_dir, n)
    none = F.lit(None).cast("map<string,string>").alias("properties")
    v = lambda df, key, base, label: df.select((F.col(key).cast("bigint") + base).alias("id"), F.lit(label).alias("label"), none)
    e = lambda df, a, x, b, y, label: df.select((F.col(a).cast("bigint") + x).alias("src"), (F.col(b).cast("bigint") + y).alias("dst"), F.lit(label).alias("label"))
    vertices = v(t("region"), "r_regionkey", 0, "region").unionByName(v(t("nation"), "n_nationkey", 100, "nation")).unionByName(v(t("supplier"), "s_suppkey", 1_000_000, "supplier")).unionByName(v(t("customer"), "c_custkey", 2_000_000, "customer")).unionByName(v(t("orders"), "o_orderkey", 10_000_000, "order"))
    edges = e(t("customer"), "c_custkey", 2_000_000, "c_nationkey", 100, "in_nation").unionByName(e(t("supplier"), "s_suppkey", 1_000_000, "s_nationkey", 100, "in_nation")).unionByName(e(t("nation"), "n_nationkey", 100, "n_regionkey", 0, "in_region")).unionByName(e(t("orders"), "o_custkey", 2_000_000, "o_orderkey", 10_000_000, "placed")).unionByName(e(t("lineitem"), "l_orderkey", 10_000_000, "l_suppkey", 1_000_000, "supplied_by").distinct())
    return Graph(vertices, graph.settled(edges.select(F.xxhash64("src", "dst", "label").alias("edge_id"), "src", "dst", "label", none)))


@query("graph_traverse", f"WITH RECURSIVE {_EDGES}, r(id, d) AS (SELECT 2000001::BIGINT, 0 UNION SELECT e.dst, d + 1 FROM r JOIN e ON e.src = r.id WHERE d < 3) SELECT DISTINCT id AS _doc_id, 0.9::DOUBLE AS _score FROM r")
def _(spark, sf_dir):
    return graph.traverse(trade_graph(spark, sf_dir), 2_000_001, 3)


@query("graph_neighbors", f"WITH RECURSIVE {_EDGES}, r(id, d) AS (SELECT 2000001::BIGINT, 0 UNION SELECT e.dst, d + 1 FROM r JOIN e ON e.src = r.id WHERE d < 2) SELECT id, min(d) AS depth FROM r GROUP BY 1 HAVING min(d) > 0")
def _(spark, sf_dir):
    return graph.neighbours(trade_graph(spark, sf_dir), 2_000_001, 2).select("id", "depth")


@query("graph_rpq", f"WITH {_EDGES} SELECT DISTINCT a.src AS start, c.dst AS _doc_id, 1.0::DOUBLE AS _score FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src WHERE a.label = 'supplied_by' AND b.label = 'in_nation' AND c.label = 'in_region'")
def _(spark, sf_dir):
    return graph.path_query(trade_graph(spark, sf_dir), "supplied_by/in_nation/in_region")


@query("graph_rpq_star", f"WITH RECURSIVE {_EDGES}, r(id) AS (SELECT 2000001::BIGINT UNION SELECT e.dst FROM r JOIN e ON e.src = r.id WHERE e.label IN ('placed', 'supplied_by', 'in_nation')) SELECT 2000001::BIGINT AS start, id AS _doc_id, 1.0::DOUBLE AS _score FROM r")
def _(spark, sf_dir):
    return graph.path_query(trade_graph(spark, sf_dir), "(placed|supplied_by|in_nation)*", 2_000_001)


@query("graph_pattern", f"WITH {_EDGES.replace('e AS (', 'e AS MATERIALIZED (', 1)}, p AS MATERIALIZED (SELECT src, dst FROM e WHERE label = 'placed'), s AS MATERIALIZED (SELECT src, dst FROM e WHERE label = 'supplied_by'), n AS MATERIALIZED (SELECT src, dst FROM e WHERE label = 'in_nation') SELECT p.src AS c, p.dst AS o, s.dst AS s FROM p JOIN s ON p.dst = s.src JOIN n ON n.src = p.src JOIN n m ON m.src = s.dst AND m.dst = n.dst")
def _(spark, sf_dir):
    edges = [EdgePattern("c", "o", "placed"), EdgePattern("o", "s", "supplied_by"), EdgePattern("c", "n", "in_nation"), EdgePattern("s", "n", "in_nation")]
    return graph.match(trade_graph(spark, sf_dir), {"c": None, "o": None, "s": None, "n": "label = 'nation'"}, edges).select("c", "o", "s")


@query("graph_pattern_neg", "SELECT 2000000 + c_custkey AS c, 100 + n_nationkey AS s FROM customer, nation WHERE n_nationkey <> c_nationkey")
def _(spark, sf_dir):
    return graph.match(trade_graph(spark, sf_dir), {"c": "label = 'customer'", "s": "label = 'nation'"}, [EdgePattern("c", "s", "in_nation", negated=True)])


@query("graph_temporal", "SELECT dst AS _doc_id, 0.9::DOUBLE AS _score FROM (SELECT DISTINCT 10000000 + o_orderkey AS dst FROM orders WHERE o_custkey = 1 AND epoch(o_orderdate) <= 883612800 UNION SELECT 2000001)")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    e = o.select(F.col("o_orderkey").alias("edge_id"), (F.col("o_custkey") + 2_000_000).alias("src"), (F.col("o_orderkey") + 10_000_000).alias("dst"), F.lit("placed").alias("label"), F.create_map(F.lit("valid_from"), F.unix_timestamp("o_orderdate").cast("string")).alias("properties"))
    return graph.traverse(Graph(trade_graph(spark, sf_dir).vertices, e).valid_at(883612800.0), 2_000_001, 1)


@query("graph_weighted", "WITH w AS (SELECT DISTINCT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey = 1) SELECT 10000000 + o_orderkey AS _doc_id, round(o_totalprice, 4) AS _score FROM w WHERE o_totalprice > 50000")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    e = o.select(F.col("o_orderkey").alias("edge_id"), (F.col("o_custkey") + 2_000_000).alias("src"), (F.col("o_orderkey") + 10_000_000).alias("dst"), F.lit("placed").alias("label"), F.create_map(F.lit("price"), F.col("o_totalprice").cast("string")).alias("properties"))
    return rounded(graph.weighted_path_query(Graph(trade_graph(spark, sf_dir).vertices, e), "placed", 2_000_001, "price", "sum", 50000.0), 4)


_VERTICES = "v AS MATERIALIZED (SELECT CAST(r_regionkey AS BIGINT) AS id FROM region UNION ALL SELECT 100 + n_nationkey FROM nation UNION ALL SELECT 1000000 + s_suppkey FROM supplier UNION ALL SELECT 2000000 + c_custkey FROM customer UNION ALL SELECT 10000000 + o_orderkey FROM orders)"
_WHOLE = f"WITH {_EDGES.replace('e AS (', 'e AS MATERIALIZED (', 1)}, {_VERTICES}, g AS MATERIALIZED (SELECT src, dst, count(*) OVER (PARTITION BY src) AS n FROM e)"


def _ranks(rounds: int) -> str:
    parts = ["r0 AS (SELECT id, 1.0::DOUBLE / count(*) OVER () AS r FROM v)"]
    for i in range(rounds):
        parts.append(f"r{i + 1} AS MATERIALIZED (SELECT v.id, 0.15 / (SELECT count(*) FROM v) + 0.85 * coalesce(x, 0) AS r FROM v LEFT JOIN (SELECT g.dst, sum(r.r / g.n) AS x FROM g JOIN r{i} r ON r.id = g.src GROUP BY 1) m ON m.dst = v.id)")
    return ", ".join(parts)


@query("graph_pagerank", f"{_WHOLE}, {_ranks(5)} SELECT id AS _doc_id, round(r, 10) AS _score FROM r5")
def _(spark, sf_dir):
    return rounded(graph.pagerank(trade_graph(spark, sf_dir), rounds=5, tolerance=0.0, scaled=False), 10)


@query("graph_degree", f"{_WHOLE}, a AS (SELECT src AS id, count(*) AS n FROM g GROUP BY 1), b AS (SELECT dst AS id, count(*) AS n FROM g GROUP BY 1) SELECT id, coalesce(a.n, 0) AS n_out, coalesce(b.n, 0) AS n_in FROM v LEFT JOIN a USING (id) LEFT JOIN b USING (id)")
def _(spark, sf_dir):
    return trade_graph(spark, sf_dir).degrees()


def _messages(rounds: int) -> str:
    parts = ["b AS MATERIALIZED (SELECT src AS x, dst AS y FROM g UNION ALL SELECT dst, src FROM g)", "m0 AS (SELECT id, id % 7 / 7.0::DOUBLE AS x FROM v)"]
    for i in range(rounds):
        parts.append(f"m{i + 1} AS MATERIALIZED (SELECT o.id, o.x + coalesce(n.m, 0) AS x FROM m{i} o LEFT JOIN (SELECT b.x AS id, avg(k.x) AS m FROM b JOIN m{i} k ON k.id = b.y GROUP BY 1) n ON n.id = o.id)")
    return ", ".join(parts)


@query("graph_message_passing", f"{_WHOLE}, {_messages(2)} SELECT id AS _doc_id, round(1 / (1 + exp(-x)), 6) AS _score FROM m2")
def _(spark, sf_dir):
    return rounded(graph.message_passing(trade_graph(spark, sf_dir), F.col("id") % 7 / 7.0, 2))


def _hubs(rounds: int) -> str:
    parts = ["h0 AS (SELECT id, 1.0::DOUBLE AS h FROM v)"]
    for i in range(rounds):
        parts.append(f"x{i} AS MATERIALIZED (SELECT v.id, coalesce(a, 0) AS a FROM v LEFT JOIN (SELECT e.dst, sum(h) AS a FROM e JOIN h{i} ON id = e.src GROUP BY 1) t ON t.dst = v.id), a{i + 1} AS MATERIALIZED (SELECT id, a / (SELECT sqrt(sum(a * a)) FROM x{i}) AS a FROM x{i})")
        parts.append(f"y{i} AS MATERIALIZED (SELECT v.id, coalesce(h, 0) AS h FROM v LEFT JOIN (SELECT e.src, sum(a) AS h FROM e JOIN a{i + 1} ON id = e.dst GROUP BY 1) t ON t.src = v.id), h{i + 1} AS MATERIALIZED (SELECT id, h / (SELECT sqrt(sum(h * h)) FROM y{i}) AS h FROM y{i})")
    return ", ".join(parts)


@query("graph_hits", f"{_WHOLE}, {_hubs(3)} SELECT id AS _doc_id, round((a - (SELECT min(a) FROM a3)) / (SELECT max(a) - min(a) FROM a3), 6) AS _score, round((h - (SELECT min(h) FROM h3)) / (SELECT max(h) - min(h) FROM h3), 6) AS hub_score, round((a - (SELECT min(a) FROM a3)) / (SELECT max(a) - min(a) FROM a3), 6) AS authority_score FROM a3 JOIN h3 USING (id)")
def _(spark, sf_dir):
    return rounded(graph.hits(trade_graph(spark, sf_dir), rounds=3, tolerance=0.0))


@query("graph_betweenness")
def _(spark, sf_dir):
    return rounded(graph.betweenness(trade_graph(spark, sf_dir)), 9)


@query("graph_embedding")
def _(spark, sf_dir):
    return graph.embedding(trade_graph(spark, sf_dir), 8, 2)


@query("text_to_graph", "WITH q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM benchmark) SELECT a.term AS a, b.term AS b, count(*) AS n FROM q a JOIN q b ON a.item_id = b.item_id AND a.term < b.term GROUP BY 1, 2 HAVING count(*) >= 2")
def _(spark, sf_dir):
    return graph.cooccurrence(text.index(table(spark, sf_dir, "benchmark"), "item_id", ["text"], "plain").postings, 2)


@query("text_join_jaccard", "WITH a AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS s FROM benchmark) SELECT x.item_id AS left_id, y.item_id AS right_id, round(len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))), 6) AS jaccard FROM a x, a y WHERE len(list_intersect(x.s, y.s)) > 0 AND len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))) >= 0.1")
def _(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return rounded(scalar.text_similarity_join(b, b, ("item_id", "text"), ("item_id", "text"), 0.1))


# --- scalar functions that Spark spells or means otherwise -----------------------------------------------------------------------


@query("fn_integer_math", "SELECT o_orderkey, gcd(o_orderkey, o_custkey) AS g, lcm(o_orderkey, o_custkey) AS l, trunc(o_totalprice) AS t FROM orders")
def _(spark, sf_dir):
    a, b = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(a, scalar.gcd(a, b).alias("g"), scalar.lcm(a, b).alias("l"), scalar.trunc(F.col("o_totalprice")).alias("t"))


@query("fn_postgres", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS c, strftime(o_orderdate, '%d.%m.%Y') AS d, (o_orderdate < TIMESTAMP '1997-01-01' AND TIMESTAMP '1995-01-01' < o_orderdate + INTERVAL 30 DAY) AS o, CASE WHEN o_totalprice < 1000 THEN 0 WHEN o_totalprice >= 400000 THEN 9 ELSE CAST(floor((o_totalprice - 1000) / (399000 / 8.0)) + 1 AS INT) END AS b FROM orders")
def _(spark, sf_dir):
    d = F.col("o_orderdate")
    ts = lambda s: F.to_timestamp(F.lit(s))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalar.to_char(d, "YYYY-MM-DD HH24:MI:SS").alias("c"), scalar.to_char(d, "DD.MM.YYYY").alias("d"), scalar.overlaps(d, d + F.expr("INTERVAL 30 DAYS"), ts("1995-01-01"), ts("1997-01-01")).alias("o"), F.width_bucket(F.col("o_totalprice"), F.lit(1000.0), F.lit(400000.0), F.lit(8)).cast("int").alias("b"))


@query("cte_recursive_distinct", "WITH RECURSIVE r(k) AS (SELECT CAST(0 AS BIGINT) UNION SELECT (k * 3 + 1) % 25 FROM r) SELECT k FROM r")
def _(spark, sf_dir):
    return scalar.recursive_union(spark.sql("SELECT CAST(0 AS BIGINT) AS k"), lambda new: new.select(((F.col("k") * 3 + 1) % 25).alias("k")))


# --- layered models ----------------------------------------------------------------------------------------------------------------


@query("deep_learn_predict")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    model = deep.deep_learn(e, "label", "embedding", [{"kind": "conv", "n": 4, "size": 3, "init": "orthogonal"}, {"kind": "pool", "size": 2}])
    return rounded(deep.deep_predict(e, "vec_id", "embedding", model).select(ID, "label", SCORE))


@query("deep_fusion")
def _(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    p = signals.signal(g.vertices, "id", (F.col("id") % 25 + 1) / 26.0)
    state = deep.propagate(deep.convolve(deep.from_signals([p]), g, [0.6, 0.4]), g)
    return rounded(deep.softmax(deep.dense(state, [[1.0], [-1.0]], [0.0, 0.5], "relu")).select(ID, SCORE))
