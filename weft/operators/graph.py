"""Property graphs as two DataFrames, and traversal, path, pattern, centrality and message-passing operators over them.

Iterations write their frontier into the shared checkpoint folder, so that lineage stays short and lost executors cost one round.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.fusion import sigmoid
from weft.operators.packed import HELD, Full, Packed, chunks, pack, pull, spread
from weft.operators.signals import ID, SCORE

VERTEX = "id bigint, label string, properties map<string,string>"
EDGE = "edge_id bigint, src bigint, dst bigint, label string, properties map<string,string>"


def shared(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="weft-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again."""
    at = f"{shared(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


@dataclass
class Graph:
    """vertices (id, label, properties) and edges (edge_id, src, dst, label, properties), properties being maps of strings."""

    vertices: DataFrame
    edges: DataFrame

    def union(self, o: Graph) -> Graph:
        return Graph(self.vertices.unionByName(o.vertices).dropDuplicates(["id"]), self.edges.unionByName(o.edges).dropDuplicates(["edge_id"]))

    def intersect(self, o: Graph) -> Graph:
        return Graph(self.vertices.join(o.vertices.select("id"), "id", "left_semi"), self.edges.join(o.edges.select("edge_id"), "edge_id", "left_semi"))

    def difference(self, o: Graph) -> Graph:
        v = self.vertices.join(o.vertices.select("id"), "id", "left_anti")
        e = self.edges.join(o.edges.select("edge_id"), "edge_id", "left_anti")
        return Graph(v, e.join(v.select(F.col("id").alias("src")), "src", "left_semi").join(v.select(F.col("id").alias("dst")), "dst", "left_semi"))

    def valid_at(self, ts: float | tuple[float, float]) -> Graph:
        """Edges valid at a time, or at some time of an interval; a missing valid_from or valid_to is no bound."""
        a, b = ts if isinstance(ts, tuple) else (ts, ts)
        low, high = (F.try_element_at("properties", F.lit(k)).cast("double") for k in ("valid_from", "valid_to"))
        return Graph(self.vertices, self.edges.where((low.isNull() | (low <= b)) & (high.isNull() | (high >= a))))

    def labelled(self, *labels: str | None) -> DataFrame:
        own = [x for x in labels if x]
        return self.edges.where(F.col("label").isin(own)) if own else self.edges

    def degrees(self) -> DataFrame:
        out = self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_out"))
        into = self.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_in"))
        return self.vertices.select("id").join(out, "id", "left").join(into, "id", "left").na.fill(0, ["n_out", "n_in"])

    def label_counts(self) -> DataFrame:
        return self.vertices.groupBy("label").agg(F.count("*").alias("n"))


def steps(edges: DataFrame, direction: str = "out") -> DataFrame:
    """(a, b, edge_id): one step along an edge."""
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "edge_id")
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "edge_id")
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def hops(g: Graph, start: list[int] | DataFrame, most: int, labels: tuple[str, ...] = (), direction: str = "out", allowed: DataFrame | None = None) -> DataFrame:
    """(id, depth) of vertices reached by breadth-first search, the start at 0. `allowed` (id) bounds where paths may go.
    Each round is a join of the frontier with the edges and an anti-join with what was reached."""
    spark = g.edges.sparkSession
    now = spark.createDataFrame([(int(i),) for i in start], "id bigint") if isinstance(start, list) else start
    reached = frontier = settled(now.distinct().withColumn("depth", F.lit(0)))
    along = steps(g.labelled(*labels), direction).select("a", "b")
    for d in range(1, most + 1):
        new = frontier.join(along, frontier.id == along.a).select(F.col("b").alias("id")).distinct().join(reached.select("id"), "id", "left_anti")
        if allowed is not None:
            new = new.join(allowed.select("id"), "id", "left_semi")
        frontier = settled(new.withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def traverse(g: Graph, start: int, most: int, label: str | None = None, where: Column | None = None) -> DataFrame:
    """Vertices within `most` hops along out-edges, the start too, scored .9; a vertex that fails `where` isn't passed."""
    allowed = g.vertices.where(where).select("id") if where is not None else None
    return hops(g, [start], most, (label,) if label else (), "out", allowed).select(F.col("id").alias(ID), F.lit(0.9).alias(SCORE))


def neighbours(g: Graph, start: int, most: int = 1, labels: tuple[str, ...] = (), direction: str = "out") -> DataFrame:
    """(id, label, properties, depth, path): breadth-first, the start excluded; of several shortest paths the least."""
    along = steps(g.labelled(*labels), direction).select("a", "b")
    spark = g.edges.sparkSession
    reached = frontier = settled(spark.createDataFrame([(int(start), 0, [int(start)])], "id bigint, depth int, path array<bigint>"))
    for d in range(1, most + 1):
        new = frontier.join(along, frontier.id == along.a).select(F.col("b").alias("id"), F.concat("path", F.array("b")).alias("path"))
        new = new.groupBy("id").agg(F.min("path").alias("path")).join(reached.select("id"), "id", "left_anti")
        frontier = settled(new.select("id", F.lit(d).alias("depth"), "path"))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached.where("depth > 0").join(g.vertices, "id").select("id", "label", "properties", "depth", "path")


# --- regular path queries ------------------------------------------------------------------------------------------------


@dataclass
class NFA:
    """start, accepting states, and transitions (state, label, state)."""

    start: int
    accept: set[int]
    moves: set[tuple[int, str, int]] = field(default_factory=set)


def parse_path(text: str):
    """The tree of a path expression: labels, / (then), | (or), * + ? {m,n}, parentheses."""
    tokens = re.findall(r"[A-Za-z_][\w-]*|\{\d+(?:,\d*)?\}|[/|*+?()]", text)
    if "".join(tokens) != re.sub(r"\s+", "", text):
        raise ValueError(f"bad path expression: {text}")
    at = 0

    def peek():
        return tokens[at] if at < len(tokens) else None

    def take():
        nonlocal at
        at += 1
        return tokens[at - 1]

    def alternatives():
        parts = [sequence()]
        while peek() == "|":
            take()
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def sequence():
        parts = [repeated()]
        while peek() == "/":
            take()
            parts.append(repeated())
        return parts[0] if len(parts) == 1 else ("then", parts)

    def repeated():
        t = take() if peek() else None
        if t == "(":
            node = alternatives()
            if peek() != ")":
                raise ValueError(f"a parenthesis is open: {text}")
            take()
        elif t and re.match(r"[A-Za-z_]", t):
            node = ("label", t)
        else:
            raise ValueError(f"a label is missing: {text}")
        while (p := peek()) and p[0] in "*+?{":
            take()
            if p[0] == "{":
                m, _, n = p[1:-1].partition(",")
                node = ("times", node, int(m), int(n) if n else (int(m) if "," not in p else None))
            else:
                node = ("times", node, {"*": 0, "+": 1, "?": 0}[p], 1 if p == "?" else None)
        return node

    tree = alternatives()
    if peek():
        raise ValueError(f"bad path expression: {text}")
    return tree


def automaton(text: str) -> NFA:
    """Thompson's automaton of a path expression with its empty moves removed."""
    moves: list[tuple[int, str | None, int]] = []
    count = 0

    def new() -> int:
        nonlocal count
        count += 1
        return count - 1

    def build(node) -> tuple[int, int]:
        kind = node[0]
        if kind == "label":
            a, b = new(), new()
            moves.append((a, node[1], b))
            return a, b
        if kind == "then":
            parts = [build(p) for p in node[1]]
            for (_, x), (y, _) in zip(parts, parts[1:]):
                moves.append((x, None, y))
            return parts[0][0], parts[-1][1]
        a, b = new(), new()
        if kind == "or":
            for p in node[1]:
                x, y = build(p)
                moves.extend([(a, None, x), (y, None, b)])
            return a, b
        _, inner, low, high = node
        at = a
        for _ in range(low):
            x, y = build(inner)
            moves.append((at, None, x))
            at = y
        moves.append((at, None, b))
        if high is None:
            x, y = build(inner)
            moves.extend([(at, None, x), (y, None, x), (y, None, b)])
        else:
            for _ in range(high - low):
                x, y = build(inner)
                moves.extend([(at, None, x), (y, None, b)])
                at = y
        return a, b

    start, end = build(parse_path(text))
    empty: dict[int, set[int]] = {s: {s} for s in range(count)}
    changed = True
    while changed:
        changed = False
        for a, label, b in moves:
            if label is None:
                for s in range(count):
                    if a in empty[s] and b not in empty[s]:
                        empty[s].add(b)
                        changed = True
    real = {(s, label, b) for s in range(count) for a, label, b in moves if label is not None and a in empty[s]}
    return NFA(start, {s for s in range(count) if end in empty[s]}, real)


def _path_query(g: Graph, p: Packed, nfa: NFA, labels: list[str]) -> DataFrame:
    """path_query from all vertices: what a range of them reaches, in any state, is followed within its task."""
    n = p.n
    states = 1 + max([nfa.start, *nfa.accept, *(x for a, _, b in nfa.moves for x in (a, b))])
    moves = [(a, labels.index(label), b) for a, label, b in sorted(nfa.moves)]

    def of(a: int, b: int, most: int | None) -> tuple[int, list | None]:
        off, to = p.side("out")
        code, own = p.open("out-label", np.int16), np.arange(a, b)
        seen = now = np.sort(((own - a) * n + own) * states + nfa.start)
        held = 0
        while len(now):
            q, found = now % states, []
            for s in np.unique(q):
                here = now[q == s] // states
                each, at = spread(off, here % n)
                held += len(at)
                if most and held > most:
                    raise Full
                c = np.asarray(code[at])
                for x, label, t in moves:
                    if x == s:
                        ok = c == label
                        found.append(np.unique(((here // n)[each[ok]] * n + to[at[ok]]) * states + t))
            now = np.unique(np.concatenate(found)) if found else now[:0]
            now = now[seen[np.minimum(np.searchsorted(seen, now), len(seen) - 1)] != now]
            seen = np.insert(seen, np.searchsorted(seen, now), now)
        ends = np.unique(seen[np.isin(seen % states, sorted(nfa.accept))] // states)
        return held, [np.asarray(p.ids[ends // n + a]), np.asarray(p.ids[ends % n]), np.ones(len(ends))] if len(ends) else None

    return p.run(g.edges.sparkSession, lambda a, b: chunks(a, b, of), f"start bigint, {ID} bigint, {SCORE} double", "out")


def path_query(g: Graph, expression: str, start: int | None = None) -> DataFrame:
    """(start, _doc_id, _score 1): ends of paths whose labels the expression matches, from one vertex or from all.

    Breadth-first search over (vertex, state) to its fixpoint; only labels of the expression are scanned."""
    nfa = automaton(expression)
    spark = g.edges.sparkSession
    known = sorted({m[1] for m in nfa.moves})
    if start is None and (p := pack(g.vertices, g.labelled(*known), ("out",), labels=known)):
        return _path_query(g, p, nfa, known)
    table = spark.createDataFrame(sorted(nfa.moves), "s int, label string, t int")
    along = g.labelled(*known).select("src", "dst", "label").join(F.broadcast(table), "label").select("src", "s", "dst", "t")
    first = spark.createDataFrame([(int(start),)], "start bigint") if start is not None else g.vertices.select(F.col("id").alias("start"))
    if start is None and nfa.start not in nfa.accept:  # only vertices that have a first step
        first = first.join(along.where(F.col("s") == nfa.start).select(F.col("src").alias("start")), "start", "left_semi")
    seen = frontier = settled(first.select("start", F.col("start").alias("v"), F.lit(nfa.start).alias("q")))
    while not frontier.isEmpty():
        new = frontier.join(along, (F.col("v") == F.col("src")) & (F.col("q") == F.col("s"))).select("start", F.col("dst").alias("v"), F.col("t").alias("q")).distinct()
        frontier = settled(new.join(seen, ["start", "v", "q"], "left_anti"))
        seen = seen.unionByName(frontier)
    return seen.where(F.col("q").isin(sorted(nfa.accept))).select("start", F.col("v").alias(ID)).distinct().withColumn(SCORE, F.lit(1.0))


def weighted_path_query(g: Graph, expression: str, start: int, weight: str, how: str = "sum", above: float | None = None) -> DataFrame:
    """path_query from one vertex with a weight for each end: sum, max or min of an edge property along the path of fewest
    edges (of those the least weight) to each (vertex, state); ends need a weight over `above`."""
    nfa = automaton(expression)
    spark = g.edges.sparkSession
    table = spark.createDataFrame(sorted(nfa.moves), "s int, label string, t int")
    w = F.coalesce(F.try_element_at("properties", F.lit(weight)).cast("double"), F.lit(0.0))
    along = g.labelled(*sorted({m[1] for m in nfa.moves})).select("src", "dst", "label", w.alias("w")).join(F.broadcast(table), "label").select("src", "s", "dst", "t", "w")
    plus = {"sum": F.col("x") + F.col("w"), "max": F.greatest("x", "w"), "min": F.least("x", "w")}[how]
    zero = {"sum": 0.0, "max": float("-inf"), "min": float("inf")}[how]
    seen = frontier = settled(spark.createDataFrame([(int(start), nfa.start, zero)], "v bigint, q int, x double"))
    while not frontier.isEmpty():
        new = frontier.join(along, (F.col("v") == F.col("src")) & (F.col("q") == F.col("s"))).select(F.col("dst").alias("v"), F.col("t").alias("q"), plus.alias("x")).groupBy("v", "q").agg(F.min("x").alias("x"))
        frontier = settled(new.join(seen.select("v", "q"), ["v", "q"], "left_anti").select("v", "q", "x"))
        seen = seen.unionByName(frontier)
    ends = seen.where(F.col("q").isin(sorted(nfa.accept))).groupBy(F.col("v").alias(ID)).agg(F.min("x").alias(SCORE)).where(f"{SCORE} not in (double('inf'), double('-inf'))")
    return ends.where(F.col(SCORE) > above) if above is not None else ends


# --- patterns ------------------------------------------------------------------------------------------------------------


@dataclass
class EdgePattern:
    source: str
    target: str
    label: str | None = None
    negated: bool = False
    where: str | None = None


def match(g: Graph, vertices: dict[str, str | None], edges: list[EdgePattern], injective: bool = True) -> DataFrame:
    """A column for each variable of a pattern: a join per edge, inequalities between variables, an anti-join per negated edge.

    vertices: variable -> SQL condition over (id, label, properties), or None. Catalyst orders the joins."""
    out: DataFrame | None = None
    bound: set[str] = set()

    def candidates(v: str) -> DataFrame:
        own = g.vertices.where(vertices[v]) if vertices.get(v) else g.vertices
        return own.select(F.col("id").alias(v))

    for e in [e for e in edges if not e.negated]:
        own = g.edges.where(F.col("label") == e.label) if e.label else g.edges
        own = (own.where(e.where) if e.where else own).select(F.col("src").alias(e.source), F.col("dst").alias(e.target)).distinct()
        if out is None:
            out = own
        else:
            on = sorted(bound & {e.source, e.target})
            out = out.join(own, on) if on else out.crossJoin(own)
        for v in sorted({e.source, e.target} - bound):
            if vertices.get(v):
                out = out.join(candidates(v), v, "left_semi")
        bound |= {e.source, e.target}
        if injective:
            for v in sorted({e.source, e.target}):
                for u in sorted(bound - {e.source, e.target}):
                    out = out.where(F.col(v) != F.col(u))
            if e.source != e.target:
                out = out.where(F.col(e.source) != F.col(e.target))
    for v in vertices:
        if v not in bound:
            out = candidates(v) if out is None else out.crossJoin(candidates(v))
            if injective:
                for u in sorted(bound):
                    out = out.where(F.col(v) != F.col(u))
            bound.add(v)
    for e in [e for e in edges if e.negated]:
        own = (g.edges.where(F.col("label") == e.label) if e.label else g.edges).select(F.col("src").alias(e.source), F.col("dst").alias(e.target)).distinct()
        out = out.join(own, [e.source, e.target], "left_anti")
    return out.select(*vertices)


# --- centrality, messages, embeddings --------------------------------------------------------------------------------------


def _scaled(df: DataFrame, value: str) -> DataFrame:
    """value scaled to 0..1 by its least and greatest; 1 where all are equal."""
    r = df.agg(F.min(value).alias("a"), F.max(value).alias("b")).first()
    if r.a is None:
        return df
    return df.withColumn(value, F.lit(1.0) if r.a == r.b else (F.col(value) - r.a) / (r.b - r.a))


def _least_and_most(*columns: np.ndarray) -> list:
    return [[f(c)] for c in columns for f in (np.min, np.max)]


def _scale(values: np.ndarray, low: float, high: float) -> np.ndarray:
    """_scaled of an array."""
    return np.ones(len(values)) if low == high else (values - low) / (high - low)


def _pagerank(g: Graph, p: Packed, damping: float, rounds: int, tolerance: float, scaled: bool) -> DataFrame:
    """Each round reads the edges once by where they end, with vectors of ranks and of their shares, and shuffles nothing."""
    spark, n = g.edges.sparkSession, p.n

    def told(name: str, a: int, x: np.ndarray) -> None:
        off = p.side("out")[0]
        degree = np.diff(np.asarray(off[a : a + len(x) + 1]))
        p.put(f"r{name}", a, x)
        p.put(f"s{name}", a, np.divide(x, degree, out=np.zeros(len(x)), where=degree > 0))

    def first(a: int, b: int):
        told("0", a, np.full(b - a, 1.0 / n))
        return iter(())

    def new(i: int):
        for c in "rs":
            p.vector(f"{c}{i}")

    if n:
        new(0)
        p.run(spark, first, "x double", "in").collect()
    done = 0
    for i in range(1, rounds + 1 if n else 1):

        def step(a: int, b: int, i=i):
            off, to = p.side("in")
            share, r = p.open(f"s{i - 1}"), np.asarray(p.open(f"r{i - 1}")[a:b])
            x = (1 - damping) / n + damping * pull(off, a, b, lambda y, z: share[to[y:z]])
            told(str(i), a, x)
            yield [[float(np.abs(x - r).sum())]]

        new(i)
        change = p.run(spark, step, "d double", "in").agg(F.sum("d")).first()[0]
        p.drop(f"r{i - 1}", f"s{i - 1}")
        done = i
        if change < tolerance:
            break
    low = high = 0.0
    if scaled and n:
        got = p.run(spark, lambda a, b: iter([_least_and_most(p.open(f"r{done}")[a:b])]), "a double, b double").agg(F.min("a"), F.max("b")).first()
        low, high = got

    def rows(a: int, b: int):
        x = np.asarray(p.open(f"r{done}")[a:b])
        yield [np.asarray(p.ids[a:b]), _scale(x, low, high) if scaled else x]

    return p.run(spark, rows, f"{ID} bigint, {SCORE} double")


def pagerank(g: Graph, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, scaled: bool = True) -> DataFrame:
    """Ranks by power iteration until the summed change is below the tolerance; vertices without out-edges lose their rank."""
    if p := pack(g.vertices, g.edges, ("out", "in")):
        return _pagerank(g, p, damping, rounds, tolerance, scaled)
    n = g.vertices.count()
    if not n:
        return g.vertices.select(F.col("id").alias(ID), F.lit(0.0).alias(SCORE))
    out = g.edges.groupBy("src").agg(F.count("*").alias("n"))
    along = settled(g.edges.select("src", "dst").join(out, "src"))
    rank = settled(g.vertices.select("id", F.lit(1.0 / n).alias("r")))
    for i in range(rounds):
        got = along.join(rank, along.src == rank.id).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("r") / F.col("n")).alias("m"))
        new = rank.join(got, "id", "left").select("id", ((1 - damping) / n + damping * F.coalesce("m", F.lit(0.0))).alias("r"), F.abs((1 - damping) / n + damping * F.coalesce("m", F.lit(0.0)) - F.col("r")).alias("d"))
        new = settled(new)
        rank = new.select("id", "r")
        if (new.agg(F.sum("d")).first()[0] or 0) < tolerance:
            break
    rank = rank.select(F.col("id").alias(ID), F.col("r").alias(SCORE))
    return _scaled(rank, SCORE) if scaled else rank


def _hits(g: Graph, p: Packed, rounds: int, tolerance: float, scaled: bool) -> DataFrame:
    """Each half of a round reads the edges once; vectors are files with a length that they are divided by when read."""
    spark = g.edges.sparkSession
    length = {"h0": 1.0, "a0": 1.0}

    def ones(a: int, b: int):
        for c in ("h0", "a0"):
            p.put(c, a, np.ones(b - a))
        return iter(())

    def half(new: str, old: str, side: str) -> None:
        def step(a: int, b: int):
            off, to = p.side(side)
            x, s = p.open(old), length[old]
            got = pull(off, a, b, lambda y, z: x[to[y:z]] / s)
            p.put(new, a, got)
            yield [[float((got * got).sum())]]

        p.vector(new)
        length[new] = (p.run(spark, step, "d double", side).agg(F.sqrt(F.sum("d"))).first()[0] or 1.0) if p.n else 1.0

    for c in ("h0", "a0"):
        p.vector(c)
    p.run(spark, ones, "x double").collect()
    done = 0
    for i in range(1, rounds + 1):
        half(f"a{i}", f"h{i - 1}", "in")
        half(f"h{i}", f"a{i}", "out")
        done, change = i, 1.0
        if tolerance > 0:

            def differ(a: int, b: int, i=i):
                yield [[float(sum(np.abs(p.open(f"{c}{i}")[a:b] / length[f"{c}{i}"] - p.open(f"{c}{i - 1}")[a:b] / length[f"{c}{i - 1}"]).sum() for c in "ha"))]]

            change = p.run(spark, differ, "d double").agg(F.sum("d")).first()[0] or 0.0
        p.drop(f"a{i - 1}", f"h{i - 1}")
        if tolerance > 0 and change < tolerance:
            break
    whole = lambda a, b: [np.asarray(p.open(f"{c}{done}")[a:b]) / length[f"{c}{done}"] for c in "ha"]
    h0 = h1 = a0 = a1 = 0.0
    if scaled and p.n:
        h0, h1, a0, a1 = p.run(spark, lambda a, b: iter([_least_and_most(*whole(a, b))]), "a double, b double, c double, d double").agg(F.min("a"), F.max("b"), F.min("c"), F.max("d")).first()

    def rows(a: int, b: int):
        h, x = whole(a, b)
        if scaled:
            h, x = _scale(h, h0, h1), _scale(x, a0, a1)
        yield [np.asarray(p.ids[a:b]), x, h, x]

    return p.run(spark, rows, f"{ID} bigint, {SCORE} double, hub_score double, authority_score double")


def hits(g: Graph, rounds: int = 100, tolerance: float = 1e-6, scaled: bool = True) -> DataFrame:
    """(_doc_id, _score, hub_score, authority_score), of length 1 each round; the score is the authority."""
    if p := pack(g.vertices, g.edges, ("out", "in")):
        return _hits(g, p, rounds, tolerance, scaled)
    e = settled(g.edges.select("src", "dst"))
    now = settled(g.vertices.select("id", F.lit(1.0).alias("h"), F.lit(1.0).alias("a")))

    def unit(df, c):
        s = df.agg(F.sqrt(F.sum(F.col(c) ** 2))).first()[0] or 1.0
        return df.withColumn(c, F.col(c) / s)

    for _ in range(rounds):
        a = e.join(now, e.src == now.id).groupBy(F.col("dst").alias("id")).agg(F.sum("h").alias("a2"))
        with_a = unit(settled(now.join(a, "id", "left").select("id", "h", "a", F.coalesce("a2", F.lit(0.0)).alias("a2"))), "a2")
        h = e.join(with_a, e.dst == with_a.id).groupBy(F.col("src").alias("id")).agg(F.sum("a2").alias("h2"))
        new = settled(unit(settled(with_a.join(h, "id", "left").select("id", "h", "a", "a2", F.coalesce("h2", F.lit(0.0)).alias("h2"))), "h2"))
        change = new.agg(F.sum(F.abs(F.col("h2") - F.col("h")) + F.abs(F.col("a2") - F.col("a")))).first()[0] or 0.0
        now = new.select("id", F.col("h2").alias("h"), F.col("a2").alias("a"))
        if change < tolerance:
            break
    if scaled:
        now = _scaled(_scaled(now, "h"), "a")
    return now.select(F.col("id").alias(ID), F.col("a").alias(SCORE), F.col("h").alias("hub_score"), F.col("a").alias("authority_score"))


def _betweenness(g: Graph, p: Packed) -> DataFrame:
    n, spark = p.n, g.edges.sparkSession

    def of(a: int, b: int, most: int | None) -> tuple[int, tuple | None]:
        """Dependencies on what sources a to b reach."""
        off, to = p.side("out")
        own = np.arange(a, b)
        keys, paths, held = [(own - a) * n + own], [np.ones(b - a)], 0
        seen, links = keys[0], []
        while len(keys[-1]):
            v = keys[-1] % n
            parent, at = spread(off, v)
            held += len(parent)
            if most and held > most:
                raise Full
            key = (keys[-1] - v)[parent] + to[at]
            i = np.minimum(np.searchsorted(seen, key), len(seen) - 1)
            new = seen[i] != key
            parent, key = parent[new], key[new]
            key, child = np.unique(key, return_inverse=True)
            links.append((parent, child))
            paths.append(np.bincount(child, paths[-1][parent], len(key)))
            keys.append(key)
            seen = np.insert(seen, np.searchsorted(seen, key), key)
        got, b_ = [], np.zeros(0)
        for k in range(len(links) - 1, -1, -1):
            if k + 1 < len(keys) - 1:
                got.append((keys[k + 1] % n, b_))
            parent, child = links[k]
            b_ = np.bincount(parent, paths[k][parent] * (1 + (b_[child] if len(b_) else 0.0)) / paths[k + 1][child], len(keys[k])) if len(parent) else np.zeros(len(keys[k]))
        if not got:
            return held, None
        v, i = np.unique(np.concatenate([x for x, _ in got]), return_inverse=True)
        x = np.bincount(i, np.concatenate([y for _, y in got]), len(v))
        return held, (v[x > 0], x[x > 0])

    def run(a: int, b: int):
        ids, v, x = p.ids, np.empty(0, np.int64), np.empty(0)
        for more in chunks(a, b, of):
            v, x = np.r_[v, more[0]], np.r_[x, more[1]]
            if len(v) > HELD:
                v, i = np.unique(v, return_inverse=True)
                x = np.bincount(i, x, len(v))
                if len(v) > HELD // 2:
                    yield [np.asarray(ids[v]), x]
                    v, x = np.empty(0, np.int64), np.empty(0)
        if len(v):
            v, i = np.unique(v, return_inverse=True)
            yield [np.asarray(ids[v]), np.bincount(i, x, len(v))]

    total = p.run(spark, run, "id bigint, b double", "out").groupBy("id").agg(F.sum("b").alias("b"))
    scale = float((n - 1) * (n - 2)) if n > 2 else 1.0
    return g.vertices.select("id").join(total, "id", "left").select(F.col("id").alias(ID), F.least(F.lit(1.0), F.coalesce("b", F.lit(0.0)) / scale).alias(SCORE))


def betweenness(g: Graph) -> DataFrame:
    """Brandes' centrality over directed edges, over (n - 1)(n - 2): each task goes forward and back from the sources of a range, as many
    at once as it may hold, over the packed graph. The work is that of the pairs of a source and what it reaches; only sums are shuffled.

    A graph that can't be packed takes rounds of joins, which carry (source, vertex, paths) forward and dependencies back."""
    if p := pack(g.vertices, g.edges, ("out",), distinct=True):
        return _betweenness(g, p)
    along = settled(g.edges.select("src", "dst").distinct().where("src != dst"))
    n = g.vertices.count()
    levels = [settled(g.vertices.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("paths")))]
    seen = levels[0].select("s", "v")
    while not levels[-1].isEmpty():
        new = levels[-1].join(along, F.col("v") == F.col("src")).groupBy("s", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"))
        levels.append(settled(new.join(seen, ["s", "v"], "left_anti")))
        seen = seen.unionByName(levels[-1].select("s", "v"))
    spark, back = g.edges.sparkSession, None
    parts = [spark.createDataFrame([], "v bigint, b double")]
    for k in range(len(levels) - 2, 0, -1):
        level = levels[k]
        own = level.withColumn("b", F.lit(0.0)) if back is None else level.join(back, ["s", "v"], "left").select("s", "v", "paths", F.coalesce("b", F.lit(0.0)).alias("b"))
        own = settled(own)
        parts.append(own.select("v", "b"))
        before = levels[k - 1].select("s", F.col("v").alias("u"), F.col("paths").alias("own"))
        share = own.select("s", F.col("v").alias("w"), ((1 + F.col("b")) / F.col("paths")).alias("x")).join(along, F.col("w") == F.col("dst")).select("s", F.col("src").alias("u"), "x")
        back = share.join(before, ["s", "u"]).groupBy("s", F.col("u").alias("v")).agg(F.sum(F.col("own") * F.col("x")).alias("b"))
    total = reduce(DataFrame.unionByName, parts).groupBy(F.col("v").alias("id")).agg(F.sum("b").alias("b"))
    scale = float((n - 1) * (n - 2)) if n > 2 else 1.0
    return g.vertices.select("id").join(total, "id", "left").select(F.col("id").alias(ID), F.least(F.lit(1.0), F.coalesce("b", F.lit(0.0)) / scale).alias(SCORE))


def _message_passing(g: Graph, p: Packed, rounds: int, how: str) -> DataFrame:
    """Each round reads the edges once a side, and shuffles nothing."""
    spark, ufunc, zero = g.edges.sparkSession, np.maximum if how == "max" else np.add, float("-inf") if how == "max" else 0.0
    for i in range(rounds):

        def step(a: int, b: int, i=i):
            x, got, n = p.open(f"x{i}"), np.full(b - a, zero), np.zeros(b - a, np.int64)
            for side in ("out", "in"):
                off, to = p.side(side)
                got = ufunc(got, pull(off, a, b, lambda y, z: x[to[y:z]], ufunc, zero))
                n += np.diff(np.asarray(off[a : b + 1]))
            m = np.where(n > 0, got / np.maximum(n, 1) if how == "mean" else got, 0.0)
            p.put(f"x{i + 1}", a, x[a:b] + m)
            return iter(())

        p.vector(f"x{i + 1}")
        p.run(spark, step, "x double", "in").collect()
        p.drop(f"x{i}")
    got = p.run(spark, lambda a, b: iter([[np.asarray(p.ids[a:b]), np.asarray(p.open(f"x{rounds}")[a:b])]]), "id bigint, x double")
    return got.select(F.col("id").alias(ID), sigmoid(F.col("x")).alias(SCORE))


def message_passing(g: Graph, value: Column, rounds: int = 2, how: str = "mean") -> DataFrame:
    """Rounds of adding the mean, sum or max of all neighbours' values to each vertex's own, then a sigmoid."""
    if p := pack(g.vertices, g.edges, ("out", "in"), values={"x0": F.coalesce(value.cast("double"), F.lit(0.0))}):
        return _message_passing(g, p, rounds, how)
    both = settled(steps(g.edges, "both").select("a", "b"))
    now = g.vertices.select("id", F.coalesce(value.cast("double"), F.lit(0.0)).alias("x"))
    agg = {"mean": F.avg, "sum": F.sum, "max": F.max}[how]("x").alias("m")
    for _ in range(rounds):
        m = both.join(now, both.b == now.id).groupBy(F.col("a").alias("id")).agg(agg)
        now = settled(now.join(m, "id", "left").select("id", (F.col("x") + F.coalesce("m", F.lit(0.0))).alias("x")))
    return now.select(F.col("id").alias(ID), sigmoid(F.col("x")).alias(SCORE))


def _embedding(g: Graph, p: Packed, dims: int, k: int, labels: int) -> DataFrame:
    """Each vertex is a source whose hops are followed within its task, many at once, over the packed graph."""
    n = p.n

    def of(a: int, b: int, most: int | None) -> tuple[int, list]:
        off, to = p.side("out")
        code, own = p.open("out-label", np.int16), np.arange(a, b)
        first, at = spread(off, own)
        held = len(at)
        if most and held > most:
            raise Full
        degree = np.bincount(first, minlength=b - a)
        parts = [degree.astype(np.float64), np.diff(np.asarray(p.side("in")[0][a : b + 1])).astype(np.float64)]
        c = np.asarray(code[at])
        parts += [np.bincount(first[c == i], minlength=b - a) / np.maximum(degree, 1) for i in range(labels)]
        reach = np.unique(first * n + to[at])
        for d in range(1, k + 1):
            parts.append(np.bincount(reach // n, minlength=b - a).astype(np.float64))
            if d < k:
                of_, at = spread(off, reach % n)
                held += len(at)
                if most and held > most:
                    raise Full
                reach = np.unique(np.r_[reach, (reach // n)[of_] * n + to[at]])
                reach = reach[reach // n + a != reach % n]
        x = np.zeros((b - a, dims))
        for i, v in enumerate(parts[:dims]):
            x[:, i] = v
        size = np.zeros(b - a)
        for i in range(dims):
            size += x[:, i] * x[:, i]
        size = np.sqrt(size)
        x /= np.where(size == 0, 1.0, size)[:, None]
        return held, [np.asarray(p.ids[a:b]), pa.ListArray.from_arrays(np.arange(0, (b - a + 1) * dims, dims, dtype=np.int32) if dims else np.zeros(b - a + 1, np.int32), x.ravel())]

    return p.run(g.edges.sparkSession, lambda a, b: chunks(a, b, of), f"{ID} bigint, embedding array<double>", "out")


def embedding(g: Graph, dims: int = 16, k: int = 2) -> DataFrame:
    """(_doc_id, embedding): out- and in-degree, the shares of edge labels, and numbers of vertices within 1..k hops, padded or
    cut to `dims` and scaled to length 1."""
    labels = sorted(r.label for r in g.edges.select("label").distinct().collect() if r.label)
    if p := pack(g.vertices, g.edges, ("out", "in"), labels=labels):
        return _embedding(g, p, dims, k, len(labels))
    out = g.edges.groupBy(F.col("src").alias("id")).agg(*(F.avg(F.when(F.col("label") == x, 1.0).otherwise(0.0)).alias(f"l{i}") for i, x in enumerate(labels)))
    table = g.degrees().join(out, "id", "left")
    pairs = reach = settled(steps(g.edges).select(F.col("a").alias("id"), "b").distinct())
    for d in range(1, k + 1):
        table = table.join(reach.groupBy("id").agg(F.count("*").alias(f"h{d}")), "id", "left")
        if d < k:
            further = reach.join(pairs.select(F.col("id").alias("b"), F.col("b").alias("c")), "b").select("id", F.col("c").alias("b"))
            reach = settled(reach.unionByName(further).where("id != b").distinct())
    parts = ["n_out", "n_in", *(f"l{i}" for i in range(len(labels))), *(f"h{d}" for d in range(1, k + 1))][:dims]
    v = F.array(*(F.coalesce(F.col(p).cast("double"), F.lit(0.0)) for p in parts), *[F.lit(0.0)] * max(0, dims - len(parts)))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return table.select("id", v.alias("v")).select(F.col("id").alias(ID), F.transform("v", lambda x: x / F.coalesce(F.nullif(size, F.lit(0.0)), F.lit(1.0))).alias("embedding"))


def vertex_aggregate(g: Graph, reached: DataFrame, prop: str, how: str = "sum") -> DataFrame:
    """sum, avg, min, max or count of a property over the vertices of a signal: one row."""
    x = F.try_element_at("properties", F.lit(prop)).cast("double")
    agg = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}[how]
    return g.vertices.join(reached.select(F.col(ID).alias("id")), "id", "left_semi").agg(agg(x).alias("value"))


def from_links(docs: DataFrame, doc_id: str, links: str, label: str = "link") -> Graph:
    """A graph of documents: an edge for each element of a column of linked ids."""
    v = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.lit("document").alias("label"), F.lit(None).cast("map<string,string>").alias("properties"))
    e = docs.select(F.col(doc_id).cast("bigint").alias("src"), F.explode(links).cast("bigint").alias("dst")).distinct()
    return Graph(v, e.select(F.xxhash64("src", "dst").alias("edge_id"), "src", "dst", F.lit(label).alias("label"), F.lit(None).cast("map<string,string>").alias("properties")))


def cooccurrence(postings: DataFrame, least: int = 1) -> DataFrame:
    """(a, b, n): terms a < b and in how many documents both occur, if at least `least`."""
    t = postings.select(ID, "term").distinct()
    a, b = t.select(ID, F.col("term").alias("a")), t.select(ID, F.col("term").alias("b"))
    return a.join(b, ID).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def grid(spark: SparkSession, rows: int, columns: int, label: str = "next") -> Graph:
    """A grid of 4 neighbours: ids r x columns + c + 1, edges to the right and down."""
    cell = spark.range(rows * columns).select((F.col("id") + 1).alias("id"), (F.col("id") % columns).alias("c"), (F.col("id") / columns).cast("bigint").alias("r"))
    none = F.lit(None).cast("map<string,string>").alias("properties")
    right = cell.where(F.col("c") < columns - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    down = cell.where(F.col("r") < rows - 1).select(F.col("id").alias("src"), (F.col("id") + columns).alias("dst"))
    e = right.unionByName(down).select(F.xxhash64("src", "dst").alias("edge_id"), "src", "dst", F.lit(label).alias("label"), none)
    return Graph(cell.select("id", F.lit("cell").alias("label"), none), e)
