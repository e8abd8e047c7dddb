import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weft import streaming
from weft.functions import analysis, query_string, scalar
from weft.operators import deep, fusion, graph, signals, text, vector
from weft.operators.signals import ID, SCORE


def make(spark, rows):
    return spark.createDataFrame(rows, f"{ID} bigint, {SCORE} double")


def got(df):
    return {r[ID]: round(r[SCORE], 9) for r in df.collect()}


def test_signal_algebra(spark):
    a, b = make(spark, [(1, 1.0), (2, 0.5), (3, 0.25)]), make(spark, [(2, 0.5), (3, 0.5), (4, 1.0)])
    u = make(spark, [(i, 0.0) for i in range(6)])
    assert got(signals.union(a, b)) == got(signals.union(b, a)) == {1: 1.0, 2: 1.0, 3: 0.75, 4: 1.0}
    assert got(signals.intersect(a, b)) == {2: 1.0, 3: 0.75} and got(signals.difference(a, b)) == {1: 1.0}
    assert set(got(signals.complement(signals.complement(a, u), u))) == {1, 2, 3}
    left, right = signals.complement(signals.union(a, b), u), signals.intersect(signals.complement(a, u), signals.complement(b, u))
    assert got(left) == got(right)
    assert got(signals.top_k(signals.union(a, b), 2)) == {1: 1.0, 2: 1.0} and got(signals.threshold(a, 0.4)) == {1: 0.6, 2: 0.1}
    assert got(signals.union(a, a.limit(0))) == got(a) and got(signals.intersect(a, a.limit(0))) == {}


def test_fusion_laws(spark):
    same = [make(spark, [(1, 0.7), (2, 0.2)]) for _ in range(3)]
    assert got(fusion.log_odds(same, alpha=0.0)) == {1: 0.7, 2: 0.2}
    more = got(fusion.log_odds(same, alpha=0.5))
    assert more[1] > 0.7 and more[2] < 0.2
    assert got(fusion.prob_and(same))[1] == round(0.7**3, 9) and got(fusion.prob_or(same))[1] == round(1 - 0.3**3, 9)
    u = make(spark, [(1, 0.0), (9, 0.0)])
    assert got(fusion.prob_not(same[0], u)) == {1: 0.3, 9: 0.99}
    assert math.isclose(fusion.coverage_default(0, 10), 0.5) and math.isclose(fusion.coverage_default(10, 10), 0.01)
    extreme = [make(spark, [(1, 0.0), (2, 1.0)]), make(spark, [(1, 1.0), (2, 1.0)])]
    assert all(0 <= x <= 1 for x in got(fusion.log_odds(extreme)).values())
    labels = spark.createDataFrame([(1, 1), (2, 0)], f"{ID} bigint, label int")
    good, bad = make(spark, [(1, 0.9), (2, 0.1)]), make(spark, [(1, 0.1), (2, 0.9)])
    w = fusion.Learned(2).fit([good, bad], labels, 20).weights
    assert w[0] > w[1]
    assert list(got(fusion.progressive([([good], 2), ([bad], 1)]))) != []


@pytest.mark.parametrize("word,stem", [p.split() for p in "caresses caress,ponies poni,cats cat,feed feed,agreed agre,plastered plaster,motoring motor,sing sing,conflated conflat,troubled troubl,sized size,hopping hop,falling fall,hissing hiss,filing file,happy happi,sky sky,relational relat,conditional condit,rational ration,valenci valenc,digitizer digit,operator oper,feudalism feudal,decisiveness decis,hopefulness hope,formaliti formal,triplicate triplic,formative form,electrical electr,goodness good,revival reviv,allowance allow,inference infer,adjustable adjust,replacement replac,adoption adopt,activate activ,effective effect,probate probat,rate rate,cease ceas,controll control,roll roll".split(",")])
def test_porter(word, stem):
    assert analysis.porter(word) == stem


def test_analyzers(spark):
    assert analysis.analyze("The Cafés, running!") == ["cafe", "run"]
    analysis.create("mine", {"char_filters": ["html_strip", {"type": "mapping", "map": {"&": " and "}}], "tokenizer": {"type": "pattern", "pattern": r"\W+"}, "filters": ["lowercase", {"type": "length", "min": 2}, {"type": "synonym", "map": {"car": ["auto"]}}, {"type": "edge_ngram", "min": 2, "max": 3}]})
    assert analysis.analyze("<b>Car</b> & x", "mine") == ["ca", "car", "au", "aut", "an", "and"]
    df = spark.createDataFrame([("A b  C_1",), (None,), ("",)], "t string")
    for name, want in (("plain", [["a", "b", "c_1"], None, []]), ("whitespace", [["a", "b", "c_1"], None, []]), ("mine", [None] * 0)):
        if want:
            assert [r[0] for r in df.select(analysis.column(name)(F.col("t"))).collect()] == want
    analysis.drop("mine")
    with pytest.raises(ValueError):
        analysis.drop("standard")
    assert analysis.highlight("The red fox ran", ["fox"], "plain") == "The red <b>fox</b> ran"
    long = "aaa " * 50 + "fox jumps" + " bbb" * 50
    assert analysis.highlight(long, ["fox"], "plain", size=40, most=1).startswith("...") and "<b>fox</b>" in analysis.highlight(long, ["fox"], "plain", size=40, most=1)


def test_query_strings():
    p = query_string.parse
    assert p('a b OR NOT title:"x y"') == ("or", [("and", [("term", None, "a"), ("term", None, "b")]), ("not", ("phrase", "title", "x y"))])
    assert p("(a OR b) AND emb:[0.5, 1]") == ("and", [("or", [("term", None, "a"), ("term", None, "b")]), ("vector", "emb", [0.5, 1.0])])
    assert query_string.words(p("a NOT b c")) == ["a", "c"]
    for bad in ("", "(a", "a)", "NOT", "AND a"):
        with pytest.raises(ValueError):
            p(bad)


@given(st.lists(st.integers(0, 5), min_size=1, max_size=6), st.integers(1, 50), st.integers(1, 50))
@settings(max_examples=50, deadline=None)
def test_bm25_bounds(tfs, dl, avgdl):
    w = 2.0
    scores = [w - w / (1 + tf / (1.2 * (0.25 + 0.75 * dl / avgdl))) for tf in sorted(tfs)]
    assert all(0 <= s < w for s in scores) and scores == sorted(scores)


def test_text_edges(spark):
    docs = spark.createDataFrame([(1, "fox fox dog"), (2, "dog"), (3, None), (4, ""), (5, "cat")], "id bigint, body string")
    ix = text.index(docs, "id", ["body"], "plain")
    s = got(text.bm25(ix, "fox dog"))
    assert set(s) == {1, 2} and s[1] > s[2]
    assert math.isclose(got(text.bm25(ix, "fox fox"))[1], 2 * got(text.bm25(ix, "fox"))[1], rel_tol=1e-6)
    assert got(text.bm25(ix, "nothing")) == {} and all(0 < x < 1 for x in got(text.bayesian(ix, "fox dog")).values())


def test_scalars(spark):
    df = spark.createDataFrame([(12, 18, -2.7, "ab-cd eF", "2024-03-05 06:07:08", '{"a": {"b": null, "c": [1, 2]}}')], "a bigint, b bigint, x double, s string, t string, j string")
    c, t = F.col, F.to_timestamp("t")
    r = df.select(scalar.gcd(c("a"), c("b")).alias("g"), scalar.lcm(c("a"), c("b")).alias("l"), scalar.trunc(c("x")).alias("t"), scalar.floor_div(-c("a"), F.lit(5)).alias("d"), scalar.floor_mod(-c("a"), F.lit(5)).alias("m"), scalar.initcap(c("s")).alias("i"), scalar.left(c("s"), -3).alias("le"), scalar.right(c("s"), 2).alias("ri"), scalar.regexp_replace(c("s"), "[a-c]", "X").alias("r1"), scalar.regexp_replace(c("s"), "([a-c])", r"\1!", "g").alias("r2"), scalar.to_char(t, "DD/MM/YYYY HH24:MI").alias("ch"), scalar.age(F.to_date(F.lit("2024-03-05")), F.to_date(F.lit("2022-01-01"))).alias("ag"), scalar.make_interval(days=1, hours=2).alias("mi"), scalar.extract("dow", t).alias("dow"), scalar.trim_scale(F.lit("1.500")).alias("ts"), scalar.min_scale(F.lit("1.500")).alias("ms"), scalar.json_set(c("j"), ["a", "c", "0"], 9).alias("js"), scalar.json_strip_nulls(c("j")).alias("jn"), scalar.json_contains(c("j"), {"a": {"c": [2]}}).alias("jc"), scalar.json_typeof(c("j")).alias("jt"), scalar.json_get(c("j"), "a", "c", 1).alias("jg"), scalar.decode(scalar.encode(c("s"), "hex"), "hex").alias("e"), scalar.to_number(F.lit("$1,234.5")).alias("n"), scalar.array_upper(F.array(F.lit(1), F.lit(2))).alias("au")).first()
    assert tuple(r) == (6, 36, -2.0, -3, 3, "Ab-Cd Ef", "ab-cd", "eF", "Xb-cd eF", "a!b!-c!d eF", "05/03/2024 06:07", "2 years 2 mons 4 days", "26:00:00", 2, "1.5", 1, '{"a":{"b":null,"c":[9,2]}}', '{"a":{"c":[1,2]}}', True, "object", "2", "ab-cd eF", 1234.5, 2)


def test_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [0.0] * 6), (102, [1.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    q = x[3]
    want = np.argsort(-(u @ q))[:5].tolist()
    assert [r[ID] for r in vector.knn(df, "id", "v", q.tolist(), 5).collect()] == want
    j = {(r.left_id, r.right_id) for r in vector.join(df.where("id < 60"), df.where("id < 60"), ("id", "v"), ("id", "v"), 0.8).collect()}
    assert j == {(i, k) for i in range(60) for k in range(60) if u[i] @ u[k] >= 0.8}
    assert [r[ID] for r in vector.IVF(df.where("id < 60"), "id", "v", 4, 3).search(q.tolist(), 1, 4).collect()] == [3]
    assert all(0 < s < 1 for s in got(vector.calibrated(df, "id", "v", q.tolist(), 5)).values())


def test_vector_join_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK", 60)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 6))
    odd = [(100, None, 0), (101, [0.0] * 6, 0), (102, [1.0], 0), (103, [2.0], 0), (104, [None] * 6, 0), (None, [1.0] * 6, 0), (105, [1.0] * 6, None)]
    df = spark.createDataFrame([(i, v.tolist(), i % 3 if i > 9 else 0) for i, v in enumerate(x)] + odd, "id bigint, v array<double>, k int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    k = [i % 3 if i > 9 else 0 for i in range(80)]
    pairs = lambda *keys: {(r.left_id, r.right_id): r[SCORE] for r in vector.join(df, df, ("id", "v"), ("id", "v"), 0.3, *keys).where("left_id <> 105 and right_id <> 105").collect()}
    for got_, same in ((pairs(), lambda i, j: True), (pairs([("k", "k")]), lambda i, j: k[i] == k[j])):
        want = {(i, j): u[i] @ u[j] for i in range(80) for j in range(80) if u[i] @ u[j] >= 0.3 and same(i, j)} | {p: 1.0 for p in ((102, 102), (102, 103), (103, 102), (103, 103))}
        assert set(got_) == set(want) and all(math.isclose(got_[p], want[p]) for p in want)
    assert 105 not in {r.left_id for r in vector.join(df, df, ("id", "v"), ("id", "v"), 0.3, [("k", "k")]).collect()}
    assert vector.join(df, df, ("id", "v"), ("id", "v"), 2.0).count() == 0


def test_deep(spark):
    g = graph.grid(spark, 2, 2)
    state = spark.createDataFrame([(1, [0.9, 0.1]), (2, [0.5, 0.5]), (3, [0.5, 0.5]), (4, [0.2, 0.8])], deep.STATE)
    ch = lambda df: {r[ID]: [round(x, 6) for x in r.channels] for r in df.collect()}
    p = ch(deep.propagate(state, g))
    assert p[2][0] > 0.5 and p[1][0] == 0.9
    assert ch(deep.convolve(state, g, [1.0]))[1] == [0.9, 0.1] and abs(ch(deep.convolve(state, g, [1.0, 1.0]))[1][0] - 0.7) < 1e-6
    assert set(ch(deep.pool(state, g, 2))) == {1, 3} and ch(deep.flatten(state)) == {1: [0.9, 0.1, 0.5, 0.5, 0.5, 0.5, 0.2, 0.8]}
    assert ch(deep.dense(state, [[1, 1]], [0.5]))[4] == [1.5] and ch(deep.dropout(state, 0.5))[1] == [0.45, 0.05]
    assert abs(sum(x[0] for x in ch(deep.batch_norm(state)).values())) < 1e-5 and ch(deep.global_pool(state, "avg_max"))[1] == [0.525, 0.475, 0.9, 0.8]
    assert all(abs(sum(v) - 1) < 1e-5 for v in ch(deep.softmax(state)).values()) and len(ch(deep.attention(state))) == 4
    w = deep.estimate_conv_weights(state, ID, "channels", g, 1)
    assert abs(sum(w) - 1) < 1e-9
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    model = deep.deep_learn(e, "label", "embedding", [{"kind": "conv", "n": 4, "size": 3, "init": "orthogonal"}, {"kind": "pool", "size": 2}], lam=1.0)
    again = deep.Model.from_json(model.to_json())
    rows = deep.deep_predict(e, "vec_id", "embedding", again).join(e.withColumnRenamed("vec_id", ID).withColumnRenamed("label", "y"), ID).select("label", "y").collect()
    assert np.mean([r.label == str(r.y) for r in rows]) > 0.25  # of 10 classes
    k = deep.kernels("gabor", 3, 3)
    x = np.random.default_rng(0).normal(size=(2, 1, 5, 5))
    c = deep.grid_conv(x, k)
    assert c.shape == (2, 3, 5, 5) and np.isclose(c[0, 1, 2, 2], (x[0, 0, 1:4, 1:4] * k[1, 0]).sum())


def test_streaming(spark, tmp_path):
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props").write.parquet(str(tmp_path / "in"))
    events = streaming.read_events(spark, str(tmp_path / "in"), schema)
    streaming.run_once(streaming.tumbling(events, "ts", "1 hour", "0 seconds", "event_type"), "weft_windows", str(tmp_path / "c1"), "complete")
    assert spark.table("weft_windows").agg(F.sum("n")).first()[0] == 1000
    streaming.run_once(streaming.sessions(events, "ts", "30 minutes", "1 hour", "user_id"), "weft_sessions", str(tmp_path / "c2"), "append")
    assert spark.table("weft_sessions").count() > 0


def test_analyzers_remember_words(spark, monkeypatch):
    calls = []
    monkeypatch.setitem(analysis.FILTER, "counted", lambda o: lambda ts: calls.extend(ts) or [t + "!" for t in ts])
    monkeypatch.setattr(analysis, "_built", {})
    config = {"tokenizer": "standard", "filters": ["counted"]}
    assert analysis.build(config)("a b a") + analysis.build(config)("b a") == ["a!", "b!", "a!", "b!", "a!"] and calls == ["a", "b"]
    # a bounded number of words is kept, and they are filtered alike
    monkeypatch.setattr(analysis.Filtered, "MOST", 3)
    words = [f"w{i % 11}" for i in range(200)] + ["x" * 50] * 3
    f = analysis.Filtered([lambda ts: [t.upper() for t in ts]])
    assert [f[w] for w in words] == [(w.upper(),) for w in words] and len(f) <= 3 and len(f.old) <= 3
    assert analysis.porter("y" * 5000 + "ing") == "y" * 4999 + "i"
    df = spark.createDataFrame([(1, "The running Éclairs"), (2, None), (3, "")], "i int, t string")
    assert {r.i: r.t for r in df.select("i", analysis.column("standard")(F.col("t")).alias("t")).collect()} == {1: ["run", "eclair"], 2: None, 3: []}


def test_texts_are_read_once_for_several_queries(spark):
    df = spark.createDataFrame([(1, "the fox and the dog"), (2, "a dog"), (3, None), (4, "--"), (5, "fox fox")], "i bigint, t string")
    ix = text.index(df, "i", ["t"], "plain")
    text.prepare(ix, ix.terms("fox dog") + ix.terms("the cat"))
    both = [got(text.bm25(ix, q)) for q in ("fox dog", "the cat", "dog dog")]
    assert len(ix.asked) == 1
    assert both == [got(text.bm25(text.index(df, "i", ["t"], "plain"), q)) for q in ("fox dog", "the cat", "dog dog")] and set(both[0]) == {1, 2, 5}
    # no condition finds the tokens another time
    assert "Filter" not in ix.tokens._jdf.queryExecution().optimizedPlan().toString().replace("Filter isnotnull(t#", "")


def test_layers_over_a_packed_graph(spark, monkeypatch):
    rng = np.random.default_rng(2)
    g = graph.Graph(spark.range(30).selectExpr("id", "'x' AS label", "CAST(NULL AS map<string,string>) AS properties"), spark.createDataFrame([(i, int(a), int(b), "e", None) for i, (a, b) in enumerate(rng.integers(0, 28, (50, 2)))], graph.EDGE))
    state = spark.createDataFrame([(i, rng.uniform(0.1, 0.9, 2).tolist()) for i in range(30)], deep.STATE)
    ch = lambda df: {r[ID]: [round(x, 9) for x in r.channels] for r in df.collect()}
    every = [lambda: ch(deep.convolve(state, g, [0.6, 0.4])), lambda: ch(deep.propagate(state, g)), lambda: ch(deep.propagate(state, g, how="max", direction="in"))]
    mine, packs = [f() for f in every], []
    monkeypatch.setattr(deep, "pack", lambda *a, **b: packs.append(1))
    assert mine == [f() for f in every] and len(packs) == 3 and len(mine[0]) == 30
