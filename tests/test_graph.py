import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.cypher import Cypher, CypherError
from weft.operators import graph as G
from weft.operators import packed
from weft.operators.graph import EdgePattern, Graph
from weft.operators.signals import ID, SCORE
from weft.session import Session


@pytest.fixture(scope="module")
def people(spark):
    v = [(1, "person", {"name": "ann", "age": "30"}), (2, "person", {"name": "bob", "age": "25"}), (3, "person", {"name": "cid", "age": "41"}), (4, "person", {"name": "dan", "age": "8"}), (5, "city", {"name": "oslo"})]
    e = [(1, 1, 2, "knows", {"since": "2010", "valid_from": "0", "valid_to": "10"}), (2, 2, 3, "knows", {"since": "2015", "valid_from": "5"}), (3, 1, 3, "works_with", {}), (4, 3, 4, "knows", {"since": "2020"}), (5, 4, 1, "works_with", {}), (6, 1, 5, "lives_in", {}), (7, 2, 5, "lives_in", {})]
    return Graph(settled(spark.createDataFrame(v, G.VERTEX)), settled(spark.createDataFrame(e, G.EDGE)))


settled = G.settled


def ids(df, c=ID):
    return sorted(r[c] for r in df.collect())


def test_traversal(people):
    assert ids(G.traverse(people, 1, 1, "knows")) == [1, 2] and ids(G.traverse(people, 1, 2, "knows")) == [1, 2, 3]
    assert ids(G.traverse(people, 1, 5)) == [1, 2, 3, 4, 5]
    assert ids(G.traverse(people, 1, 5, "knows", F.col("properties")["age"].cast("int") > 26)) == [1]
    assert ids(G.traverse(people.valid_at(2.0), 1, 3, "knows")) == [1, 2]
    assert ids(G.traverse(people.valid_at((7.0, 20.0)), 1, 3, "knows")) == [1, 2, 3, 4]
    n = {r.id: (r.depth, r.path) for r in G.neighbours(people, 1, 2).collect()}
    assert n == {2: (1, [1, 2]), 3: (1, [1, 3]), 5: (1, [1, 5]), 4: (2, [1, 3, 4])}


def test_paths(people):
    assert ids(G.path_query(people, "knows/knows", 1)) == [3] and ids(G.path_query(people, "knows*", 1)) == [1, 2, 3, 4]
    assert ids(G.path_query(people, "knows|works_with", 1)) == [2, 3] and ids(G.path_query(people, "(knows/knows)|lives_in", 1)) == [3, 5]
    assert ids(G.path_query(people, "knows{2,3}", 1)) == [3, 4] and ids(G.path_query(people, "knows+", 3)) == [4] and ids(G.path_query(people, "knows?", 1)) == [1, 2]
    w = {r[ID]: r[SCORE] for r in G.weighted_path_query(people, "knows+", 1, "since", "sum").collect()}
    assert w == {2: 2010.0, 3: 4025.0, 4: 6045.0}
    for bad in ("knows/", "(a", "a)b", "/a", "a||b"):
        with pytest.raises(ValueError):
            G.automaton(bad)


def test_patterns_and_centrality(people):
    m = G.match(people, {"a": "label = 'person'", "b": "label = 'person'", "c": "label = 'city'"}, [EdgePattern("a", "b", "knows"), EdgePattern("a", "c", "lives_in"), EdgePattern("b", "c", "lives_in")])
    assert [tuple(r) for r in m.collect()] == [(1, 2, 5)]
    m = G.match(people, {"a": None, "b": None}, [EdgePattern("a", "b", "knows"), EdgePattern("b", "a", "works_with", negated=True)])
    assert sorted(tuple(r) for r in m.collect()) == [(1, 2), (2, 3), (3, 4)]
    r = {x[ID]: x[SCORE] for x in G.pagerank(people, scaled=False).collect()}
    assert abs(r[5] - (0.03 + 0.85 * (r[1] / 3 + r[2] / 2))) < 1e-4
    h = {x[ID]: x for x in G.hits(people).collect()}
    assert h[1].hub_score == 1.0 and 0 <= h[4].authority_score <= 1
    b = {x[ID]: x[SCORE] for x in G.betweenness(people).collect()}
    assert abs(b[3] - 3 / 12) < 1e-9 or b[3] > 0
    e = {x[ID]: x.embedding for x in G.embedding(people, 8).collect()}
    assert all(len(v) == 8 for v in e.values()) and abs(sum(x * x for x in e[1]) - 1) < 1e-9
    assert G.vertex_aggregate(people, G.traverse(people, 1, 1, "knows"), "age", "sum").first()[0] == 55.0
    g = people.union(Graph(people.vertices, people.edges.where("edge_id = 1")))
    assert g.edges.count() == 7 and people.difference(Graph(people.vertices.where("id = 5"), people.edges.where("edge_id = 1"))).edges.count() == 4


def test_cypher(people):
    run = lambda q, **p: [tuple(r) for r in Cypher(people, p).run(q).collect()]
    assert run("MATCH (a:person)-[:knows]->(b) RETURN a.name, b.name ORDER BY b.name") == [("ann", "bob"), ("bob", "cid"), ("cid", "dan")]
    assert run("MATCH (a:person) WHERE a.age > 26 AND a.name STARTS WITH 'a' RETURN a.name AS n, a.age + 1 AS x") == [("ann", 31.0)]
    assert run("MATCH (a {name: 'ann'})-[e:knows|works_with]->(b) RETURN b.name, type(e) ORDER BY b.name DESC LIMIT 1") == [("cid", "works_with")]
    assert run("MATCH (a {name: 'ann'})<-[:works_with]-(b) RETURN b.name") == [("dan",)]
    assert run("MATCH (a:person) OPTIONAL MATCH (a)-[:lives_in]->(c) RETURN a.name, c.name ORDER BY a.name") == [("ann", "oslo"), ("bob", "oslo"), ("cid", None), ("dan", None)]
    assert run("MATCH (a {name: 'ann'})-[p:knows*1..3]->(b) RETURN b.name, length(p) AS l ORDER BY l") == [("bob", 1), ("cid", 2), ("dan", 3)]
    assert run("MATCH (a {name: 'ann'})-[*]->(b {name: 'dan'}) RETURN count(*) AS n")[0][0] >= 2
    assert run("MATCH (a:person)-[:lives_in]->(c) RETURN c.name, count(a) AS n, collect(a.name) AS who")[0][:2] == ("oslo", 2)
    assert run("UNWIND [3, 1, 2] AS x WITH x WHERE x > 1 RETURN x * 2 AS y ORDER BY y") == [(4,), (6,)]
    assert run("MATCH (a:person) RETURN CASE WHEN a.age < 18 THEN 'kid' ELSE 'adult' END AS k, count(*) AS n ORDER BY k") == [("adult", 3), ("kid", 1)]
    assert run("MATCH (a) WHERE id(a) = $i RETURN labels(a), a.none IS NULL AS m", i=5) == [(["city"], True)]
    c = Cypher(people)
    c.run("CREATE (x:person {name: 'eve', age: 50})-[:knows {since: 2024}]->(y:person {name: 'fay'})")
    c.run("MATCH (a {name: 'eve'}) SET a.age = 51, a += {city: 'rom'}")
    assert [tuple(r) for r in c.run("MATCH (a {name: 'eve'})-[e]->(b) RETURN a.age, a.city, b.name, e.since").collect()] == [("51", "rom", "fay", "2024")]
    c.run("MERGE (z:person {name: 'eve'}) ON MATCH SET z.seen = 1 ON CREATE SET z.seen = 0")
    c.run("MERGE (z:person {name: 'gus'}) ON MATCH SET z.seen = 1 ON CREATE SET z.seen = 0")
    assert sorted(tuple(r) for r in c.run("MATCH (a) WHERE a.seen IS NOT NULL RETURN a.name, a.seen").collect()) == [("eve", "1"), ("gus", "0")]
    with pytest.raises(CypherError):
        c.run("MATCH (a {name: 'eve'}) DELETE a")
    c.run("MATCH (a {name: 'eve'}) DETACH DELETE a")
    assert c.graph.vertices.count() == 7 and c.graph.edges.count() == 7


def test_builder_and_graph_sql(spark, people, tmp_path):
    s = Session(spark)
    s.sql("CREATE TABLE docs (id SERIAL PRIMARY KEY, title TEXT, year INT, embedding VECTOR(2))")
    s.sql("INSERT INTO docs (title, year, embedding) VALUES ('red fox', 2001, ARRAY[1.0, 0.0]), ('red dog', 2002, ARRAY[0.0, 1.0]), ('blue fox', 2003, ARRAY[0.7, 0.7])")
    q = s.query("docs")
    assert ids(q.term("fox", "title").execute(), "id") == [1, 3]
    assert ids(q.term("fox", "title").and_(q.term("red", "title")).execute(), "id") == [1]
    assert ids(q.term("fox", "title").or_(q.term("dog", "title")).filter("year > 2001").execute(), "id") == [2, 3]
    assert ids(q.term("fox", "title").not_().execute(), "id") == [2]
    assert [r.id for r in q.score_bm25("fox", "title").top(1).execute().collect()] == [1]
    f = q.score_bayesian_bm25("fox", "title").knn([1.0, 0.0], 2, "embedding").fuse_log_odds()
    assert ids(f.execute(), "id") == [1, 3] and "fuse_log_odds" in f.explain()
    assert q.facet("year").count() == 3 and q.aggregate("year", "max").first()[0] == 2003
    q.term("fox", "title").execute_parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2 and q.execute_arrow().num_rows == 3
    s.state.graphs["docs"] = people
    assert ids(s.sql("SELECT id FROM docs WHERE traverse_match(1, 'knows', 1)"), "id") == [1, 2]
    assert ids(s.sql("SELECT id FROM docs WHERE text_match(title, 'fox') AND traverse_match(1, 'knows', 2)"), "id") == [1, 3]
    assert ids(s.sql("SELECT * FROM rpq('knows/knows', 1)"), "id") == [3]
    s.state.graphs["g"] = people
    got = s.sql("SELECT n FROM cypher('g', $$ MATCH (a:person)-[:lives_in]->(c) RETURN a.name $$) AS (n agtype) ORDER BY n").collect()
    assert [r.n for r in got] == ["ann", "bob"]
    assert ids(s.sql("SELECT id, depth FROM graph_neighbors('g', 1, 'knows', 'outgoing', 2)"), "id") == [2, 3]
    s.sql("SELECT * FROM graph_create_node('h', 'x', '{\"a\": 1}')")
    s.sql("SELECT * FROM graph_create_node('h', 'x')")
    s.sql("SELECT * FROM graph_create_edge('h', 'e', 1, 2)")
    assert s.sql("SELECT * FROM graph_edges('h')").count() == 1 and s.sql("SELECT * FROM graph_nodes('h', 'x', '{\"a\": 1}')").count() == 1
    s.sql("SELECT build_grid_graph('grid', 3, 3, 'n')")
    assert s.sql("SELECT * FROM graph_edges('grid')").count() == 12


def random_graph(spark, n, m, seed=5):
    r = random.Random(seed)
    e = [(i, r.randrange(n), r.randrange(n), r.choice(["a", "b", "", None]), None) for i in range(m)]
    return Graph(settled(spark.createDataFrame([(7 * i - 20, "x", None) for i in range(n)], G.VERTEX)), settled(spark.createDataFrame([(i, 7 * a - 20, 7 * b - 20, x, y) for i, a, b, x, y in e], G.EDGE)))


def plain(df):
    return sorted(tuple([round(y, 9) for y in x] if isinstance(x, list) else round(x, 9) for x in r) for r in df.collect())


def by_joins(monkeypatch, f):
    with monkeypatch.context() as m:
        m.setattr(G, "pack", lambda *a, **b: None)
        return plain(f())


@pytest.mark.parametrize("n, m", [(50, 130), (4, 0)])
def test_betweenness_of_a_packed_graph(spark, monkeypatch, n, m):
    g = random_graph(spark, n, m)
    assert G.pack(g.vertices, g.edges) is not None
    assert plain(G.betweenness(g)) == by_joins(monkeypatch, lambda: G.betweenness(g))


def test_packing(spark, monkeypatch):
    g = random_graph(spark, 50, 200)
    p = G.pack(g.vertices, g.edges, ("out", "in"), values={"v": F.col("id") * 2.0}, labels=["a", "b"])
    assert p.ids.tolist() == [7 * i - 20 for i in range(50)] and p.open("v").tolist() == [2.0 * x for x in p.ids] and p.sides == {"out": 200, "in": 200}
    edges = {s: sorted((r.src, r.dst) if s == "out" else (r.dst, r.src) for r in g.edges.collect()) for s in ("out", "in")}
    for s in ("out", "in"):
        off, to = p.side(s)
        of, at = packed.spread(off, np.arange(50))
        assert [(int(p.ids[a]), int(p.ids[to[b]])) for a, b in zip(of, at)] == edges[s]
        monkeypatch.setattr(packed, "WINDOW", 7)
        assert packed.pull(off, 3, 40, lambda x, y: p.open("v")[to[x:y]]).tolist() == [2.0 * sum(b for a, b in edges[s] if a == i) for i in p.ids[3:40]]
    # chunks shrink until they hold no more than they may, but for one source
    monkeypatch.setattr(packed, "HELD", 10)

    def work(a, b, most):
        held = sum(i % 13 for i in range(a, b))
        if most and held > most:
            raise packed.Full
        return held, [a, b]

    got = list(packed.chunks(0, 500, work))
    assert got[0][0] == 0 and got[-1][1] == 500 and all(x[1] == y[0] for x, y in zip(got, got[1:])) and all(b - a == 1 or work(a, b, None)[0] <= 10 for a, b in got)
    # what can't be packed: edges of no vertex, repeated ids
    assert G.pack(g.vertices.where("id > 0"), g.edges) is None and G.pack(g.vertices.union(g.vertices), g.edges) is None


@pytest.mark.parametrize("f", [
    lambda g: G.pagerank(g, rounds=2, tolerance=0.0), lambda g: G.hits(g, rounds=2, tolerance=0.0), lambda g: G.message_passing(g, F.col("id") % 7 / 7.0, 1, "max"),
    lambda g: G.message_passing(g, F.col("id") % 7 / 7.0, 2), lambda g: G.embedding(g, 8, 2), lambda g: G.path_query(g, "a/b*"),
], ids=["pagerank", "hits", "max", "mean", "embedding", "paths"])
def test_whole_graphs_are_packed(spark, monkeypatch, f):
    g = random_graph(spark, 40, 110)
    packs = []
    with monkeypatch.context() as m:
        m.setattr(G, "pack", lambda *a, real=G.pack, **b: packs.append(real(*a, **b)) or packs[-1])
        mine = plain(f(g))
    assert packs and packs[0] is not None and mine == by_joins(monkeypatch, lambda: f(g))
