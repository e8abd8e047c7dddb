"""openCypher over property graphs: clauses become joins of vertices and edges, expressions become columns.

A row of bindings holds a struct for each variable: vertices (id, label, properties), edges (edge_id, src, dst, label,
properties), or plain values. Reads are lazy DataFrames; CREATE, MERGE, SET and DELETE make a new graph.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.graph import Graph, settled

TOKEN = re.compile(r"\s*(?:(//[^\n]*)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+\.\d+|\d+)|(\$\w+)|(`[^`]+`|[A-Za-z_]\w*)|(<=|>=|<>|<-|->|\.\.|\+=|[-+*/%^=<>()\[\]{},.:|]))", re.S)
CLAUSES = {"MATCH", "OPTIONAL", "WHERE", "CREATE", "MERGE", "SET", "DELETE", "DETACH", "WITH", "RETURN", "UNWIND", "ORDER", "SKIP", "LIMIT", "ON", "UNION"}


class CypherError(ValueError):
    """A query that can't be parsed or run."""


class Cypher:
    #: Rounds after which an unbounded path stops with an error instead of running on.
    DEPTH = 30

    def __init__(self, graph: Graph, params: dict | None = None):
        self.graph, self.params = graph, params or {}
        self.spark = graph.vertices.sparkSession

    # --- tokens

    def run(self, query: str) -> DataFrame:
        self.ts, at = [], 0
        query = query.strip().rstrip(";")
        while at < len(query):
            m = TOKEN.match(query, at)
            if not m or m.end() == at:
                if not query[at:].strip():
                    break
                raise CypherError(f"bad query: {query[at:at + 30]}")
            at = m.end()
            if not m[1]:
                self.ts.append(m[0].strip())
        self.i, self.names = 0, 0
        self.rows: DataFrame = self.spark.range(1).select(F.lit(1).alias("_unit"))
        self.kind: dict[str, str] = {}
        out = None
        while self.i < len(self.ts):
            word = self.peek().upper()
            if word == "MATCH":
                self.take()
                self._match(False)
            elif word == "OPTIONAL":
                self.take(), self.take()
                self._match(True)
            elif word == "UNWIND":
                self._unwind()
            elif word in ("CREATE", "MERGE"):
                self.take()
                self._create(word == "MERGE")
            elif word == "SET":
                self.take()
                self._set()
            elif word in ("DELETE", "DETACH"):
                self._delete()
            elif word == "WITH":
                self.take()
                self._project()
            elif word == "RETURN":
                self.take()
                out = self._project()
            else:
                raise CypherError(f"unexpected {self.peek()}")
        return out if out is not None else self.rows

    def peek(self, k: int = 0) -> str:
        return self.ts[self.i + k] if self.i + k < len(self.ts) else ""

    def take(self, want: str | None = None) -> str:
        t = self.peek()
        if want and t.upper() != want:
            raise CypherError(f"{want} expected, not {t or 'the end'}")
        self.i += 1
        return t

    def taken(self, want: str) -> bool:
        if self.peek().upper() == want:
            self.i += 1
            return True
        return False

    def fresh(self) -> str:
        self.names += 1
        return f"_{self.names}"

    # --- patterns

    def _map(self) -> dict[str, Column]:
        out = {}
        if self.taken("{"):
            while not self.taken("}"):
                k = self.take().strip("`")
                self.take(":")
                out[k] = self.expression()
                self.taken(",")
        return out

    def _node(self) -> tuple[str, str | None, dict]:
        self.take("(")
        name = self.take().strip("`") if re.match(r"[A-Za-z_`]", self.peek()) else self.fresh()
        label = self.take().strip("`") if self.taken(":") else None
        props = self._map()
        self.take(")")
        return name, label, props

    def _edge(self) -> tuple[str, list[str], dict, str, tuple[int, int | None] | None]:
        back = self.peek() == "<-"
        self.take()
        name, labels, props, span = self.fresh(), [], {}, None
        if self.taken("["):
            if re.match(r"[A-Za-z_`]", self.peek()):
                name = self.take().strip("`")
            if self.taken(":"):
                labels.append(self.take().strip("`"))
                while self.taken("|"):
                    self.taken(":")
                    labels.append(self.take().strip("`"))
            if self.taken("*"):
                low = int(self.take()) if self.peek().isdigit() else None
                high = low
                if self.taken(".."):
                    high = int(self.take()) if self.peek().isdigit() else None
                elif low is None:
                    high = None
                span = (low if low is not None else 1, high)
            props = self._map()
            self.take("]")
        end = self.take()
        direction = "in" if back else "out" if end == "->" else "both"
        return name, labels, props, direction, span

    def _path(self):
        nodes, edges = [self._node()], []
        while self.peek() in ("-", "<-"):
            edges.append(self._edge())
            nodes.append(self._node())
        return nodes, edges

    def _vertices(self, name: str, label: str | None, props: dict) -> DataFrame:
        v = self.graph.vertices
        if label:
            v = v.where(F.col("label") == label)
        v = v.select(F.struct("id", "label", "properties").alias(name))
        for k, x in props.items():
            v = v.where(self.prop(name, k) == x.cast("string"))
        return v

    def prop(self, name: str, key: str) -> Column:
        return F.try_element_at(F.col(f"`{name}`.properties"), F.lit(key))

    def _bind(self, rows: DataFrame, bound: set[str], node) -> DataFrame:
        name, label, props = node
        if name not in bound:
            rows = rows.crossJoin(self._vertices(name, label, props))
            bound.add(name)
            self.kind[name] = "vertex"
            return rows
        if label:
            rows = rows.where(F.col(f"`{name}`.label") == label)
        for k, x in props.items():
            rows = rows.where(self.prop(name, k) == x.cast("string"))
        return rows

    def _steps(self, labels: list[str], direction: str, props: dict) -> DataFrame:
        e = self.graph.edges.where(F.col("label").isin(labels)) if labels else self.graph.edges
        for k, x in props.items():
            e = e.where(F.try_element_at("properties", F.lit(k)) == x.cast("string"))
        own = F.struct("edge_id", "src", "dst", "label", "properties")
        out = e.select(F.col("src").alias("_a"), F.col("dst").alias("_b"), own.alias("_e"))
        back = e.select(F.col("dst").alias("_a"), F.col("src").alias("_b"), own.alias("_e"))
        return {"out": out, "in": back, "both": out.unionByName(back.where("_a != _b"))}[direction]

    def _hop(self, rows: DataFrame, bound: set[str], a: str, edge, node) -> DataFrame:
        name, labels, props, direction, span = edge
        target, label, tprops = node
        steps = self._steps(labels, direction, props)
        if span is None:
            rows = rows.join(steps, F.col(f"`{a}`.id") == F.col("_a"))
            own = [n for n in bound if self.kind.get(n) == "edge" and n in self._in_match]
            for n in own:
                rows = rows.where(F.col(f"`{n}`.edge_id") != F.col("_e.edge_id"))
            rows = rows.withColumnRenamed("_e", name).drop("_a")
            self.kind[name] = "edge"
            self._in_match.add(name)
        else:
            low, high = span
            at = rows.withColumn("_b", F.col(f"`{a}`.id")).withColumn("_p", F.array().cast("array<struct<edge_id:bigint,src:bigint,dst:bigint,label:string,properties:map<string,string>>>"))
            found = at if low == 0 else None
            for d in range(1, (high if high is not None else self.DEPTH + 1) + 1):
                nxt = at.withColumnRenamed("_b", "_at").join(steps, F.col("_at") == F.col("_a")).where(~F.exists("_p", lambda e: e["edge_id"] == F.col("_e.edge_id")))
                at = settled(nxt.withColumn("_p", F.array_append("_p", F.col("_e"))).drop("_at", "_a", "_e"))
                if at.isEmpty():
                    break
                if d > self.DEPTH:
                    raise CypherError("a path of unbounded length grew too long")
                if d >= low:
                    found = at if found is None else found.unionByName(at)
            rows = (found if found is not None else at.limit(0)).withColumnRenamed("_p", name)
            self.kind[name] = "path"
        bound.add(name)
        if target in bound:
            rows = rows.where(F.col(f"`{target}`.id") == F.col("_b")).drop("_b")
            return self._bind(rows, bound, node)
        v = self._vertices(target, label, tprops)
        rows = rows.join(v, F.col("_b") == F.col(f"`{target}`.id")).drop("_b")
        bound.add(target)
        self.kind[target] = "vertex"
        return rows

    def _match(self, optional: bool):
        before, bound = self.rows, set(self.rows.columns)
        self._in_match: set[str] = set()
        key = None
        if optional:
            key = self.fresh()
            before = settled(before.withColumn(key, F.monotonically_increasing_id()))
        rows = before
        while True:
            nodes, edges = self._path()
            rows = self._bind(rows, bound, nodes[0])
            for k, e in enumerate(edges):
                rows = self._hop(rows, bound, nodes[k][0], e, nodes[k + 1])
            if not self.taken(","):
                break
        if self.taken("WHERE"):
            rows = rows.where(self.expression())
        if optional:
            new = [c for c in rows.columns if c not in before.columns]
            rows = before.join(rows.select(key, *(f"`{c}`" for c in new)), key, "left").drop(key)
        self.rows = rows

    def _unwind(self):
        self.take()
        x = self.expression()
        self.take("AS")
        name = self.take()
        self.rows = self.rows.withColumn(name, F.explode(x))
        self.kind[name] = "value"

    # --- changes

    def _create(self, merge: bool):
        while True:
            nodes, edges = self._path()
            sets = {"CREATE": [], "MATCH": []}
            while self.peek().upper() == "ON":
                self.take()
                sets[self.take().upper()] += self._assignments()
            if merge:
                self._merge(nodes, edges, sets)
                if not self.taken(","):
                    return
                continue
            self._make(nodes, edges)
            if not self.taken(","):
                return

    def _make(self, nodes, edges) -> None:
        """New vertices and edges of a path for every row, but for the vertices that it has."""
        self.rows = settled(self.rows)
        for name, label, props in nodes:
            if name in self.rows.columns:
                continue
            top = self.graph.vertices.agg(F.max("id")).first()[0] or 0
            v = F.struct((F.row_number().over(_one()) + top).cast("bigint").alias("id"), F.lit(label or "").alias("label"), self._properties(props).alias("properties"))
            self.rows = settled(self.rows.withColumn(name, v))
            self.kind[name] = "vertex"
            self.graph = Graph(settled(self.graph.vertices.unionByName(self.rows.select(f"`{name}`.*"))), self.graph.edges)
        for k, (name, labels, props, direction, _) in enumerate(edges):
            a, b = nodes[k][0], nodes[k + 1][0]
            if direction == "in":
                a, b = b, a
            top = self.graph.edges.agg(F.max("edge_id")).first()[0] or 0
            e = F.struct((F.row_number().over(_one()) + top).cast("bigint").alias("edge_id"), F.col(f"`{a}`.id").alias("src"), F.col(f"`{b}`.id").alias("dst"), F.lit(labels[0] if labels else "").alias("label"), self._properties(props).alias("properties"))
            self.rows = settled(self.rows.withColumn(name, e))
            self.kind[name] = "edge"
            self.graph = Graph(self.graph.vertices, settled(self.graph.edges.unionByName(self.rows.select(f"`{name}`.*"))))

    def _found(self, rows: DataFrame, nodes, edges) -> DataFrame:
        """Rows joined with the paths that they match; properties that depend on a row are compared after the join."""
        bound, held = set(rows.columns), []
        self._in_match = set()

        def free(node):
            name, label, props = node
            held.extend((name, k, x) for k, x in props.items())
            return name, label, {}

        open_nodes = [free(n) for n in nodes]
        open_edges = [(n, labels, {}, d, span) for n, labels, props, d, span in edges]
        held += [(n, k, x) for n, _, props, _, _ in edges for k, x in props.items()]
        rows = self._bind(rows, bound, open_nodes[0])
        for k, e in enumerate(open_edges):
            rows = self._hop(rows, bound, open_nodes[k][0], e, open_nodes[k + 1])
        for name, k, x in held:
            rows = rows.where(F.try_element_at(F.col(f"`{name}`.properties"), F.lit(k)) == x.cast("string"))
        return settled(rows)

    def _merge(self, nodes, edges, sets) -> None:
        """MERGE row by row: rows that match the path take what they match; for those that don't, each path that they ask for is
        made once, and ON CREATE applies to the rows it was made for."""
        key = self.fresh()
        before, kinds = settled(self.rows.withColumn(key, F.monotonically_increasing_id())), dict(self.kind)
        hit = self._found(before, nodes, edges)
        made_kinds = dict(self.kind)
        missing = settled(before.join(hit.select(key), key, "left_anti"))
        parts = []
        if not hit.isEmpty():
            self.rows = hit
            self._apply(sets["MATCH"])
            parts.append(self.rows)
        if not missing.isEmpty():
            # one row for each path that is asked for: what it takes from rows are the vertices at hand and the properties
            asked = [F.col(f"`{n}`.id") for n, _, _ in nodes if n in before.columns] + [x.cast("string") for _, _, props in nodes for x in props.values()] + [x.cast("string") for _, _, props, _, _ in edges for x in props.values()]
            first = missing.groupBy(F.to_json(F.array(*(F.coalesce(a.cast("string"), F.lit("")) for a in asked))) if asked else F.lit(1)).agg(F.min(key).alias(key)).select(key)
            self.rows, self.kind = settled(missing.join(first, key, "left_semi")), dict(kinds)
            self._make(nodes, edges)
            self._apply(sets["CREATE"])
            made = self.rows
            again = missing.join(first, key, "left_anti")
            parts.append(made)
            again = settled(again)
            if not again.isEmpty():
                parts.append(self._found(again, nodes, edges))
        self.kind = made_kinds
        columns = [c for c in parts[0].columns if c != key]
        out = parts[0].select(*(f"`{c}`" for c in columns))
        for p in parts[1:]:
            out = out.unionByName(p.select(*(f"`{c}`" for c in columns)))
        self.rows = settled(out)

    def _properties(self, props: dict) -> Column:
        pairs = [y for k, x in props.items() for y in (F.lit(k), x.cast("string"))]
        return (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>")

    def _assignments(self) -> list:
        self.take("SET")
        return self._set_list()

    def _set_list(self) -> list:
        out = []
        while True:
            name = self.take().strip("`")
            if self.taken("."):
                key = self.take().strip("`")
                self.take("=")
                out.append((name, key, self.expression()))
            else:
                add = self.take() == "+="
                out.append((name, None, (add, self._map())))
            if not self.taken(","):
                return out

    def _set(self):
        self._apply(self._set_list())

    def _apply(self, sets: list):
        for name, key, value in sets:
            old = F.col(f"`{name}`.properties")
            given = {key: value} if key else value[1]
            keep = F.map_filter(old, lambda k, v: ~k.isin(list(given))) if key or value[0] else F.create_map().cast("map<string,string>")
            new = F.map_filter(self._properties(given), lambda k, v: v.isNotNull())
            rows = settled(self.rows.withColumn(name, F.col(name).withField("properties", F.map_concat(keep, new))))
            self.rows = rows
            if self.kind[name] == "vertex":
                changed = rows.select(f"`{name}`.*").dropDuplicates(["id"])
                self.graph = Graph(settled(self.graph.vertices.join(changed.select("id"), "id", "left_anti").unionByName(changed)), self.graph.edges)
            else:
                changed = rows.select(f"`{name}`.*").dropDuplicates(["edge_id"])
                self.graph = Graph(self.graph.vertices, settled(self.graph.edges.join(changed.select("edge_id"), "edge_id", "left_anti").unionByName(changed)))

    def _delete(self):
        detach = self.taken("DETACH")
        self.take("DELETE")
        self.rows = settled(self.rows)
        while True:
            name = self.take().strip("`")
            if self.kind[name] == "edge":
                gone = self.rows.select(F.col(f"`{name}`.edge_id").alias("edge_id")).distinct()
                self.graph = Graph(self.graph.vertices, settled(self.graph.edges.join(gone, "edge_id", "left_anti")))
            else:
                gone = self.rows.select(F.col(f"`{name}`.id").alias("id")).distinct()
                tied = self.graph.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(self.graph.edges.join(gone.withColumnRenamed("id", "dst"), "dst", "left_semi"))
                if not detach and not tied.isEmpty():
                    raise CypherError("a vertex with edges is deleted: use DETACH DELETE")
                self.graph = Graph(settled(self.graph.vertices.join(gone, "id", "left_anti")), settled(self.graph.edges.join(tied.select("edge_id"), "edge_id", "left_anti")))
            if not self.taken(","):
                return

    # --- projections

    def _project(self) -> DataFrame:
        distinct = self.taken("DISTINCT")
        items: list[tuple[str, Column, bool]] = []
        if self.taken("*"):
            items = [(c, F.col(f"`{c}`"), False) for c in self.rows.columns if not c.startswith("_")]
            self.taken(",")
        while self.peek() and self.peek().upper() not in CLAUSES:
            start, self.aggregates = self.i, 0
            x = self.expression()
            name = "".join(self.ts[start : self.i]).strip("`")
            if self.taken("AS"):
                name = self.take().strip("`")
            items.append((name, x, self.aggregates > 0))
            if self.ts[start] in self.kind and self.i - start <= 3:
                self.kind[name] = self.kind[self.ts[start]]
            if not self.taken(","):
                break
        keys = [x.alias(n) for n, x, agg in items if not agg]
        order: list[tuple[int, bool]] = []
        if any(agg for *_, agg in items):
            out = self.rows.groupBy(*keys).agg(*(x.alias(n) for n, x, agg in items if agg)) if keys else self.rows.agg(*(x.alias(n) for n, x, agg in items))
            out = out.select(*(f"`{n}`" for n, *_ in items))
            after = True
        else:
            after = distinct
            out = self.rows.select(*keys) if distinct else self.rows.select("*", *(x.alias(f"__{k}") for k, (n, x, _) in enumerate(items)))
            out = out.distinct() if distinct else out
        if self.taken("ORDER"):
            self.take("BY")
            by = []
            while True:
                start = self.i
                names = {n for n, *_ in items}
                if self.peek().strip("`") in names and self.peek(1) not in (".", "("):
                    k = next(k for k, (n, *_) in enumerate(items) if n == self.peek().strip("`"))
                    self.take()
                    x = F.col(f"`{items[k][0]}`") if after else F.col(f"__{k}")
                else:
                    x = self.expression()
                    text = "".join(self.ts[start : self.i])
                    if after and text in names:
                        x = F.col(f"`{text}`")
                down = self.taken("DESC") or self.taken("DESCENDING")
                if not down:
                    self.taken("ASC")
                by.append(x.desc_nulls_first() if down else x.asc_nulls_last())
                if not self.taken(","):
                    break
            out = out.orderBy(*by)
        if not after:
            out = out.select(*(F.col(f"__{k}").alias(n) for k, (n, *_) in enumerate(items)))
        if self.taken("SKIP"):
            out = out.offset(int(self.take()))
        if self.taken("LIMIT"):
            out = out.limit(int(self.take()))
        for n, *_ in items:
            self.kind.setdefault(n, "value")
        self.rows = out
        if self.taken("WHERE"):
            self.rows = out = out.where(self.expression())
        return out

    # --- expressions

    def expression(self) -> Column:
        x = self._xor()
        while self.taken("OR"):
            x = x | self._xor()
        return x

    def _xor(self) -> Column:
        x = self._and()
        while self.taken("XOR"):
            y = self._and()
            x = (x | y) & ~(x & y)
        return x

    def _and(self) -> Column:
        x = self._not()
        while self.taken("AND"):
            x = x & self._not()
        return x

    def _not(self) -> Column:
        return ~self._not() if self.taken("NOT") else self._compare()

    def _compare(self) -> Column:
        x = self._sum()
        while True:
            t = self.peek().upper()
            if t in ("=", "<>", "<", "<=", ">", ">="):
                self.take()
                y = self._sum()
                x = {"=": lambda a, b: a.eqNullSafe(b), "<>": lambda a, b: ~a.eqNullSafe(b), "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[t](*_alike(x, y))
            elif t == "IN":
                self.take()
                x = F.array_contains(self._sum(), x)
            elif t in ("STARTS", "ENDS"):
                self.take(), self.take("WITH")
                y = self._sum()
                x = x.cast("string").startswith(y) if t == "STARTS" else x.cast("string").endswith(y)
            elif t == "CONTAINS":
                self.take()
                x = x.cast("string").contains(self._sum())
            elif t == "IS":
                self.take()
                no = self.taken("NOT")
                self.take("NULL")
                x = x.isNotNull() if no else x.isNull()
            else:
                return x

    def _sum(self) -> Column:
        x = self._product()
        while self.peek() in ("+", "-"):
            op, y = self.take(), self._product()
            x, y = _number(x), _number(y)
            x = x + y if op == "+" else x - y
        return x

    def _product(self) -> Column:
        x = self._power()
        while self.peek() in ("*", "/", "%"):
            op, y = self.take(), self._power()
            x, y = _number(x), _number(y)
            x = x * y if op == "*" else F.try_divide(x, y) if op == "/" else F.try_mod(x, y)
        return x

    def _power(self) -> Column:
        x = self._unary()
        while self.taken("^"):
            x = F.pow(_number(x), _number(self._unary()))
        return x

    def _unary(self) -> Column:
        if self.taken("-"):
            return -_number(self._unary())
        x = self._atom()
        while True:
            if self.peek() == "." and re.match(r"[A-Za-z_`]", self.peek(1)):
                self.take()
                key = self.take().strip("`")
                x = _tag(F.try_element_at(x["properties"], F.lit(key)))
            elif self.peek() == "[":
                self.take()
                k = self.expression()
                self.take("]")
                x = F.try_element_at(x, F.when(k.cast("int") < 0, k.cast("int")).otherwise(k.cast("int") + 1))
            else:
                return x

    def _atom(self) -> Column:
        t = self.take()
        up = t.upper()
        if not t:
            raise CypherError("an expression is missing")
        if t == "(":
            x = self.expression()
            self.take(")")
            return x
        if t == "[":
            parts = []
            while not self.taken("]"):
                parts.append(self.expression())
                self.taken(",")
            return F.array(*parts)
        if t == "{":
            self.i -= 1
            return F.struct(*(x.alias(k) for k, x in self._map().items()))
        if t[0] in "'\"":
            return F.lit(re.sub(r"\\(.)", r"\1", t[1:-1]))
        if t[0].isdigit():
            return F.lit(float(t)) if "." in t else F.lit(int(t))
        if t[0] == "$":
            return F.lit(self.params[t[1:]])
        if up in ("TRUE", "FALSE", "NULL"):
            return F.lit({"TRUE": True, "FALSE": False, "NULL": None}[up])
        if up == "CASE":
            base = None if self.peek().upper() == "WHEN" else self.expression()
            x = None
            while self.taken("WHEN"):
                c = self.expression()
                self.take("THEN")
                v = self.expression()
                c = c if base is None else base.eqNullSafe(c)
                x = F.when(c, v) if x is None else x.when(c, v)
            if self.taken("ELSE"):
                x = x.otherwise(self.expression())
            self.take("END")
            return x
        if self.peek() == "(":
            return self._call(t)
        return F.col(f"`{t.strip('`')}`")

    def _call(self, name: str) -> Column:
        self.take("(")
        low, star, args = name.lower(), False, []
        distinct = self.taken("DISTINCT")
        first = self.peek()
        while not self.taken(")"):
            if self.taken("*"):
                star = True
            else:
                args.append(self.expression())
            self.taken(",")
        if low in ("count", "collect", "sum", "avg", "min", "max"):
            self.aggregates = getattr(self, "aggregates", 0) + 1
            if low == "count":
                return F.count("*") if star else F.count_distinct(args[0]) if distinct else F.count(args[0])
            if low == "collect":
                return F.collect_set(args[0]) if distinct else F.collect_list(args[0])
            x = _number(args[0])
            return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[low](x if low in ("sum", "avg") else args[0])
        a = args[0] if args else None
        kind = self.kind.get(first, "value")
        simple = {"labels": lambda: F.array(a["label"]), "label": lambda: a["label"], "type": lambda: a["label"], "properties": lambda: a["properties"], "keys": lambda: F.map_keys(a["properties"]), "tostring": lambda: a.cast("string"), "tointeger": lambda: a.try_cast("bigint"), "tofloat": lambda: a.try_cast("double"), "length": lambda: F.size(a) if kind == "path" else F.length(a), "head": lambda: F.try_element_at(a, F.lit(1)), "last": lambda: F.try_element_at(a, F.lit(-1)), "tail": lambda: F.slice(a, 2, 1_000_000), "reverse": lambda: F.reverse(a), "abs": lambda: F.abs(_number(a)), "coalesce": lambda: F.coalesce(*args), "tolower": lambda: F.lower(a), "lower": lambda: F.lower(a), "toupper": lambda: F.upper(a), "upper": lambda: F.upper(a), "trim": lambda: F.trim(a), "replace": lambda: F.replace(a, args[1], args[2]), "split": lambda: F.split(a, args[1]), "startnode": lambda: a["src"], "endnode": lambda: a["dst"], "range": lambda: F.sequence(*args), "size": lambda: F.size(a)}
        if low == "id":
            return a["edge_id"] if kind == "edge" else a["id"]
        if low == "substring":
            return a.substr(args[1].cast("int") + 1, args[2].cast("int") if len(args) > 2 else F.length(a))
        if low not in simple:
            raise CypherError(f"no such function: {name}")
        return simple[low]()


def _one():
    """A window over all new rows: they are numbered for their ids; what one statement creates is small."""
    from pyspark.sql import Window

    return Window.orderBy(F.lit(0))


def _tag(x: Column) -> Column:
    x._weft_property = True
    return x


def _number(x: Column) -> Column:
    """A property, which is stored as text, as a number."""
    return x.try_cast("double") if vars(x).get("_weft_property") else x


def _alike(x: Column, y: Column) -> tuple[Column, Column]:
    """A property is compared as a number with numbers, as text with the rest."""
    a, b = vars(x).get("_weft_property", False), vars(y).get("_weft_property", False)
    if a == b:
        return x, y
    other = y if a else x
    is_text = F.typeof(other) == "string"
    p = x if a else y
    text, number = p, p.try_cast("double")
    made = F.when(is_text, text).otherwise(number.cast("string"))
    shown = F.when(is_text, other.cast("string")).otherwise(other.try_cast("double").cast("string"))
    # both as numbers where both are: otherwise order would be that of text
    left, right = (made, shown) if a else (shown, made)
    return F.struct(left.try_cast("double").alias("n"), F.when(is_text, left).alias("t")), F.struct(right.try_cast("double").alias("n"), F.when(is_text, right).alias("t"))


