"""Sessions: PostgreSQL-flavoured SQL with scored search over versioned tables, named graphs, analyzers, models and transactions.

A table is a pointer to an immutable DataFrame; a statement that changes it writes a new version and moves the pointer, so that a
transaction is a copy of pointers and a rollback puts them back. Relational work goes to Spark SQL as it stands; signal functions
in WHERE become joins with signals, made by weft.operators.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft import dialect, sources
from weft.dialect import Token, closing, literal, significant, split, text_of, tokens, type_of
from weft.functions import analysis, postgres, query_string
from weft.operators import fusion, graph, nested, signals, spatial, text, vector
from weft.operators.graph import Graph, settled
from weft.operators.signals import ID, SCORE

SETTINGS = {"server_version": "17.0", "client_encoding": "UTF8", "timezone": "UTC", "datestyle": "ISO, MDY", "search_path": '"$user", public', "standard_conforming_strings": "on", "application_name": "", "statement_timeout": "0", "work_mem": "4MB", "transaction_isolation": "serializable"}
SIGNALS = {"text_match", "bayesian_match", "bayesian_match_with_prior", "knn_match", "bayesian_knn_match", "traverse_match", "temporal_traverse", "path_filter", "vector_exclude", "spatial_within", "fuse_log_odds", "fuse_prob_and", "fuse_prob_or", "fuse_prob_not", "fuse_attention", "fuse_multihead", "fuse_learned", "sparse_threshold", "multi_field_match", "message_passing", "staged_retrieval", "pagerank", "hits", "betweenness", "weighted_rpq", "progressive_fusion", "rpq"}
TABLE_FUNCTIONS = {"generate_series", "unnest", "regexp_split_to_table", "json_each", "jsonb_each", "json_each_text", "jsonb_each_text", "json_array_elements", "jsonb_array_elements", "json_array_elements_text", "jsonb_array_elements_text", "text_search", "traverse", "temporal_traverse", "rpq", "pagerank", "hits", "betweenness", "cypher", "create_graph", "graph_create", "drop_graph", "graph_drop", "graph_add_vertex", "graph_add_edge", "graph_create_node", "graph_create_edge", "graph_nodes", "graph_edges", "graph_neighbors", "graph_traverse", "graph_delete_node", "graph_delete_edge", "build_grid_graph", "create_analyzer", "drop_analyzer", "list_analyzers", "set_table_analyzer"}


class SQLError(ValueError):
    """A statement that can't be run, or breaks a constraint."""


@dataclass(frozen=True)
class Table:
    df: DataFrame
    key: str | None = None
    defaults: tuple[tuple[str, str], ...] = ()
    serial: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    checks: tuple[str, ...] = ()
    references: tuple[tuple[str, str, str], ...] = ()
    fields: tuple[tuple[str, str], ...] = ()  # text column -> analyzer
    #: What the next value of a serial column is.
    counters: tuple[tuple[str, int], ...] = ()


@dataclass
class State:
    tables: dict[str, Table] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)
    graphs: dict[str, Graph] = field(default_factory=dict)
    sequences: dict[str, dict] = field(default_factory=dict)
    indexes: dict[str, tuple[str, str, tuple[str, ...]]] = field(default_factory=dict)

    def copy(self) -> State:
        return State(dict(self.tables), dict(self.views), dict(self.graphs), {k: dict(v) for k, v in self.sequences.items()}, dict(self.indexes))


class Session:
    def __init__(self, spark: SparkSession):
        self.spark, self.state = spark, State()
        self.settings, self.prepared = dict(SETTINGS), {}
        self.servers: dict[str, sources.Server] = {}
        self.foreign: dict[str, DataFrame] = {}
        self.models: dict[str, str] = {}
        self.params: dict[str, dict] = {}
        self.saved: list[tuple[str, State]] = []
        self.tag = f"weft-{uuid.uuid4().hex[:8]}"
        postgres.register(spark)

    # --- tables and documents

    def table(self, name: str) -> DataFrame:
        name = name.lower().removeprefix("public.")
        if name in self.state.tables:
            return self.state.tables[name].df
        if name in self.foreign:
            return self.foreign[name]
        raise SQLError(f"no such table: {name}")

    def register(self, name: str, df: DataFrame, key: str | None = None, fields: dict[str, str] | None = None) -> None:
        """An existing DataFrame as a table."""
        self.state.tables[name.lower()] = Table(df, key, fields=tuple((fields or {}).items()))

    def key(self, name: str) -> str:
        t = self.state.tables.get(name.lower())
        return t.key if t and t.key else self.table(name).columns[0]

    def add_document(self, doc: dict, table: str) -> None:
        t = self.state.tables[table]
        row = self.spark.createDataFrame([json.dumps(doc)], "string").select(F.from_json("value", t.df.schema).alias("r")).select("r.*")
        self._put(table, t.df.unionByName(row))

    def get_document(self, doc_id: int, table: str) -> dict | None:
        r = self.table(table).where(F.col(self.key(table)) == doc_id).first()
        return r.asDict(True) if r else None

    def delete_document(self, doc_id: int, table: str) -> None:
        self._put(table, self.table(table).where(~F.col(self.key(table)).eqNullSafe(F.lit(doc_id))))

    def query(self, table: str):
        from weft.api import Query

        return Query(self, table)

    def _put(self, name: str, df: DataFrame, **changes) -> None:
        self.state.tables[name] = replace(self.state.tables[name], df=settled(df), **changes)

    def cancel(self) -> None:
        """Stop the jobs that this session's statements have running."""
        self.spark.interruptTag(self.tag)

    def save_model(self, name: str, config: dict) -> None:
        self.models[name] = json.dumps(config)

    def load_model(self, name: str) -> dict | None:
        return json.loads(self.models[name]) if name in self.models else None

    def delete_model(self, name: str) -> None:
        self.models.pop(name, None)

    def learn_scoring_params(self, table: str, column: str, query: str, labels: DataFrame, name: str | None = None) -> dict:
        """alpha, beta and base rate of the Bayesian score of a query, fitted to labels (_doc_id, label)."""
        s = text.bm25(self.index(table, [column]), query, column).join(labels, ID)
        got = text.learn_parameters(s, SCORE, "label")
        self.params[name or f"{table}.{column}"] = got
        return got

    def calibration_report(self, table: str, column: str, query: str, labels: DataFrame) -> DataFrame:
        return text.calibration_report(text.bayesian(self.index(table, [column]), query, column).join(labels, ID), SCORE, "label")

    def index(self, table: str, columns: list[str] | None = None) -> text.Index:
        """The text index of a table: of its indexed columns, or of all its strings."""
        t = self.state.tables.get(table.lower()) or Table(self.table(table))
        known = dict(t.fields)
        columns = columns or list(known) or [c for c, k in t.df.dtypes if k == "string"]
        return text.index(t.df, self.key(table), columns, known.get(columns[0], "standard"))

    # --- statements

    def sql(self, statement: str, params: list | None = None) -> DataFrame | None:
        """Run statements; the last one's rows, or None where it has none."""
        out = None
        for s in dialect.statements(statement):
            out = self._run(self._bound(s, params or []))
        return out

    def _bound(self, s: str, params: list) -> str:
        def text_for(v) -> str:
            if v is None:
                return "NULL"
            if isinstance(v, str):
                return "'" + v.replace("'", "''") + "'"
            if isinstance(v, bool):
                return str(v).upper()
            return f"ARRAY[{', '.join(map(repr, map(float, v)))}]" if hasattr(v, "__len__") else repr(v)

        return text_of([Token("string", text_for(params[int(t.text[1:]) - 1])) if t.kind == "param" and params else t for t in tokens(s)])

    def _run(self, s: str) -> DataFrame | None:
        ws = significant(tokens(s))
        head = " ".join(t.low for t in ws[:2])
        first = ws[0].low
        for names, run in (
            (("create table", "create temp", "create temporary"), self._create_table), (("create sequence", "alter sequence"), self._sequence), (("create index", "create unique"), self._create_index), (("create view", "create or"), self._create_view),
            (("create server",), self._create_server), (("create foreign",), self._create_foreign), (("create schema", "drop schema"), lambda s: None), (("alter table",), self._alter), (("drop table", "drop view", "drop index", "drop sequence", "drop server", "drop foreign"), self._drop),
        ):
            if head in names:
                return run(s)
        runs = {"insert": self._insert, "update": self._update, "delete": self._delete, "truncate": self._truncate, "begin": self._begin, "start": self._begin, "commit": self._commit, "end": self._commit, "rollback": self._rollback, "abort": self._rollback, "savepoint": self._savepoint, "release": self._release, "set": self._set, "show": self._show, "reset": self._reset, "discard": self._reset, "prepare": self._prepare, "execute": self._execute, "deallocate": self._deallocate, "explain": self._explain, "analyze": self._analyze}
        if first in runs:
            return runs[first](s)
        return self._select(s)

    # --- definitions

    def _create_table(self, s: str) -> None:
        m = re.match(r"(?is)^create\s+(?:temp(?:orary)?\s+)?table\s+(if\s+not\s+exists\s+)?([\w.\"]+)\s*(\(|as\b)", s)
        if not m:
            raise SQLError(f"bad CREATE TABLE: {s}")
        name = m[2].strip('"').lower().removeprefix("public.")
        if name in self.state.tables:
            if m[1]:
                return None
            raise SQLError(f"table {name} exists")
        if m[3].lower() == "as":
            self.state.tables[name] = Table(settled(self._select(s[m.end() :].strip())))
            return None
        ts = tokens(s)
        at = next(i for i, t in enumerate(ts) if t.text == "(")
        cols, t = [], {"defaults": [], "serial": [], "required": [], "unique": [], "checks": [], "references": []}
        key = None
        for part in split(ts[at + 1 : closing(ts, at)]):
            p = significant(part)
            low = [x.low for x in p]
            if low[0] == "constraint":
                p, low = p[2:], low[2:]
            if low[:2] == ["primary", "key"]:
                key = p[3].text.strip('"').lower()
                t["required"].append(key)
                continue
            if low[0] == "unique":
                t["unique"].append(p[2].text.lower())
                continue
            if low[0] == "check":
                t["checks"].append(text_of(part[next(i for i, x in enumerate(part) if x.text == "(") :]))
                continue
            if low[:2] == ["foreign", "key"]:
                t["references"].append((p[3].text.lower(), p[6].text.lower(), p[8].text.lower()))
                continue
            col = p[0].text.strip('"').lower()
            end = next((i for i in range(2, len(p)) if low[i] in ("primary", "not", "null", "default", "unique", "check", "references", "constraint", "generated")), len(p))
            cols.append((col, type_of(p[1:end])))
            if low[1] in ("serial", "bigserial"):
                t["serial"].append(col)
            i = end
            while i < len(p):
                if low[i] == "primary":
                    key = col
                    t["required"].append(col)
                    i += 2
                elif low[i] == "not":
                    t["required"].append(col)
                    i += 2
                elif low[i] == "unique":
                    t["unique"].append(col)
                    i += 1
                elif low[i] == "check":
                    e = closing(p, i + 1)
                    t["checks"].append(" ".join(x.text for x in p[i + 1 : e + 1]))
                    i = e + 1
                elif low[i] == "references":
                    t["references"].append((col, p[i + 1].text.lower(), p[i + 3].text.lower() if i + 3 < len(p) and p[i + 2].text == "(" else ""))
                    i += 5
                elif low[i] == "default":
                    e = next((j for j in range(i + 2, len(p)) if low[j] in ("primary", "not", "unique", "check", "references")), len(p))
                    t["defaults"].append((col, " ".join(x.text for x in p[i + 1 : e])))
                    i = e
                else:
                    i += 1
        df = self.spark.createDataFrame([], ", ".join(f"{c} {k}" for c, k in cols))
        self.state.tables[name] = Table(df, key or (t["serial"] or [None])[0], **{k: tuple(v) for k, v in t.items()}, counters=tuple((c, 1) for c in t["serial"]))
        return None

    def _create_view(self, s: str) -> None:
        m = re.match(r"(?is)^create\s+(?:or\s+replace\s+)?(?:temp\w*\s+)?view\s+([\w.]+)\s+as\s+(.*)$", s)
        self.state.views[m[1].lower()] = m[2]

    def _create_index(self, s: str) -> None:
        m = re.match(r"(?is)^create\s+(?:unique\s+)?index\s+(?:if\s+not\s+exists\s+)?(\w+)\s+on\s+([\w.]+)\s*(?:using\s+(\w+))?\s*\(([^)]*)\)(.*)$", s)
        if not m:
            raise SQLError(f"bad CREATE INDEX: {s}")
        name, table, kind, cols = m[1].lower(), m[2].lower(), (m[3] or "btree").lower(), tuple(c.strip().split()[0].lower() for c in m[4].split(","))
        self.state.indexes[name] = (table, kind, cols)
        if kind == "gin":
            a = re.search(r"analyzer\s*=\s*'?(\w+)", m[5])
            t = self.state.tables[table]
            self.state.tables[table] = replace(t, fields=tuple(dict(t.fields).items() | {(c, a[1] if a else "standard") for c in cols}))

    def _create_server(self, s: str) -> None:
        m = re.match(r"(?is)^create\s+server\s+(?:if\s+not\s+exists\s+)?(\w+)\s+foreign\s+data\s+wrapper\s+(\w+)(.*)$", s)
        self.servers[m[1].lower()] = sources.Server(m[2].lower(), self._options(m[3]))

    def _options(self, s: str) -> dict[str, str]:
        m = re.search(r"(?is)options\s*\((.*)\)", s)
        return {k.lower(): v.replace("''", "'") for k, v in re.findall(r"(\w+)\s+'((?:[^']|'')*)'", m[1])} if m else {}

    def _create_foreign(self, s: str) -> None:
        m = re.match(r"(?is)^create\s+foreign\s+table\s+(?:if\s+not\s+exists\s+)?(\w+)\s*\((.*?)\)\s*server\s+(\w+)(.*)$", s)
        cols = [f"{p.split()[0]} {type_of(tokens(p.split(None, 1)[1]))}" for p in map(str.strip, m[2].split(",")) if p]
        self.foreign[m[1].lower()] = self.servers[m[3].lower()].table(self.spark, ", ".join(cols), self._options(m[4]))

    def _sequence(self, s: str) -> None:
        m = re.match(r"(?is)^(create|alter)\s+sequence\s+(?:if\s+not\s+exists\s+)?(\w+)(.*)$", s)
        q = self.state.sequences.setdefault(m[2].lower(), {"next": 1, "step": 1, "last": None})
        if i := re.search(r"(?i)increment\s+(?:by\s+)?(-?\d+)", m[3]):
            q["step"] = int(i[1])
        if i := re.search(r"(?i)(?:re)?start\s+(?:with\s+)?(-?\d+)", m[3]):
            q["next"] = int(i[1])

    def _alter(self, s: str) -> None:
        m = re.match(r"(?is)^alter\s+table\s+(?:if\s+exists\s+)?(\w+)\s+(.*)$", s)
        name, what = m[1].lower(), m[2].strip()
        t = self.state.tables[name]
        if r := re.match(r"(?is)rename\s+to\s+(\w+)", what):
            self.state.tables[r[1].lower()] = self.state.tables.pop(name)
        elif r := re.match(r"(?is)rename\s+(?:column\s+)?(\w+)\s+to\s+(\w+)", what):
            self._put(name, t.df.withColumnRenamed(r[1].lower(), r[2].lower()), key=r[2].lower() if t.key == r[1].lower() else t.key)
        elif r := re.match(r"(?is)add\s+constraint\s+\w+\s+check\s*(\(.*\))", what):
            self._check_all(replace(t, checks=(*t.checks, r[1])), t.df)
            self.state.tables[name] = replace(t, checks=(*t.checks, r[1]))
        elif r := re.match(r"(?is)add\s+(?:column\s+)?(?:if\s+not\s+exists\s+)?(\w+)\s+(\w+(?:\s*\([^)]*\))?(?:\[\])?)\s*(?:default\s+(.*))?", what):
            value = F.expr(dialect.rewrite(r[3])) if r[3] else F.lit(None)
            self._put(name, t.df.withColumn(r[1].lower(), value.cast(type_of(tokens(r[2])))), defaults=(*t.defaults, (r[1].lower(), r[3])) if r[3] else t.defaults)
        elif r := re.match(r"(?is)drop\s+(?:column\s+)?(?:if\s+exists\s+)?(\w+)", what):
            self._put(name, t.df.drop(r[1].lower()))
        elif r := re.match(r"(?is)alter\s+(?:column\s+)?(\w+)\s+(?:set\s+data\s+)?type\s+(.*)", what):
            self._put(name, t.df.withColumn(r[1].lower(), F.col(r[1]).cast(type_of(tokens(r[2])))))
        elif r := re.match(r"(?is)alter\s+(?:column\s+)?(\w+)\s+(set|drop)\s+default\s*(.*)", what):
            d = {k: v for k, v in t.defaults if k != r[1].lower()} | ({r[1].lower(): r[3]} if r[2].lower() == "set" else {})
            self.state.tables[name] = replace(t, defaults=tuple(d.items()))
        elif r := re.match(r"(?is)alter\s+(?:column\s+)?(\w+)\s+(set|drop)\s+not\s+null", what):
            c = r[1].lower()
            new = replace(t, required=(*t.required, c) if r[2].lower() == "set" else tuple(x for x in t.required if x != c))
            self._check_all(new, t.df)
            self.state.tables[name] = new
        else:
            raise SQLError(f"bad ALTER TABLE: {s}")

    def _drop(self, s: str) -> None:
        m = re.match(r"(?is)^drop\s+(foreign\s+table|\w+)\s+(if\s+exists\s+)?([\w.]+)", s)
        place = {"table": self.state.tables, "view": self.state.views, "index": self.state.indexes, "sequence": self.state.sequences, "server": self.servers}.get(m[1].lower(), self.foreign)
        if place.pop(m[3].lower().removeprefix("public."), None) is None and not m[2]:
            raise SQLError(f"nothing to drop: {m[3]}")

    def _truncate(self, s: str) -> None:
        name = significant(tokens(s))[-1].low
        self._put(name, self.table(name).limit(0))

    # --- changes

    def _check_all(self, t: Table, df: DataFrame) -> None:
        """One aggregate for all row constraints, one for each unique column and each reference."""
        tests = [(f"{c} is null", F.col(c).isNull()) for c in dict.fromkeys(t.required)] + [(f"check {c}", ~F.expr(dialect.rewrite(c))) for c in t.checks]
        if tests:
            r = df.agg(*(F.max(F.coalesce(c, F.lit(False))).alias(f"t{i}") for i, (_, c) in enumerate(tests))).first()
            for i, (what, _) in enumerate(tests):
                if r[i]:
                    raise SQLError(f"constraint: {what}")
        for c in dict.fromkeys([*([t.key] if t.key and t.key in t.required else []), *t.unique]):
            if not df.where(F.col(c).isNotNull()).groupBy(c).count().where("count > 1").isEmpty():
                raise SQLError(f"constraint: {c} is not unique")
        for c, other, col in t.references:
            o = self.table(other).select(F.col(col or self.key(other)).alias("_r"))
            if not df.where(F.col(c).isNotNull()).join(o, F.col(c) == F.col("_r"), "left_anti").isEmpty():
                raise SQLError(f"constraint: {c} references a row that {other} lacks")

    def _check_referenced(self, name: str) -> None:
        for t in self.state.tables.values():
            if any(other == name for _, other, _ in t.references):
                self._check_all(replace(t, required=(), unique=(), checks=(), key=None), t.df)

    def _returning(self, s: str) -> tuple[str, str | None]:
        ts = tokens(s)
        at = next((i for i, t in enumerate(ts) if t.low == "returning"), None)
        return (text_of(ts[:at]), text_of(ts[at + 1 :])) if at is not None else (s, None)

    def _given(self, df: DataFrame, returning: str | None) -> DataFrame | None:
        return df.selectExpr(*(dialect.rewrite(text_of(p)).strip() for p in split(tokens(returning)))) if returning else None

    def _insert(self, s: str) -> DataFrame | None:
        s, returning = self._returning(s)
        m = re.match(r"(?is)^insert\s+into\s+([\w.]+)\s*(?:\(([^)]*)\))?\s*(values|select|with)\b(.*)$", s)
        if not m:
            raise SQLError(f"bad INSERT: {s}")
        name = m[1].lower().removeprefix("public.")
        t = self.state.tables[name]
        body, conflict = m[3] + m[4], None
        if c := re.search(r"(?is)\son\s+conflict\s*(?:\(([^)]*)\))?\s*do\s+(nothing|update\s+set\s+(.*))$", body):
            body, conflict = body[: c.start()], c
        cols = [x.strip().strip('"').lower() for x in m[2].split(",")] if m[2] else None
        new = self._select(body)
        cols = cols or t.df.columns[: len(new.columns)]
        if len(cols) != len(new.columns):
            raise SQLError("as many values as columns are needed")
        new = new.toDF(*cols)
        counters = dict(t.counters)
        if missing := [c for c in t.serial if c not in cols]:
            # numbered before it is written, in the order in which the statement gives the rows
            numbered = T.StructType([*new.schema.fields, T.StructField("_n", T.LongType())])
            new = settled(self.spark.createDataFrame(new.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), numbered))
            n = new.count()
            for c in missing:
                new = new.withColumn(c, F.col("_n") + counters[c])
                counters[c] += n
            new = new.drop("_n")
        else:
            new = settled(new)
            for c in t.serial:
                top = new.agg(F.max(c)).first()[0]
                counters[c] = max(counters[c], (top or 0) + 1)
        given = dict(t.defaults)
        new = new.select(*((F.col(c) if c in new.columns else F.expr(dialect.rewrite(self._functions(given[c]))) if c in given else F.lit(None)).cast(k).alias(c) for c, k in t.df.dtypes))
        old = t.df
        if conflict:
            on = [x.strip().lower() for x in conflict[1].split(",")] if conflict[1] else [t.key]
            match = [old[c] == new[c] for c in on]
            if conflict[2].lower() == "nothing":
                new = settled(new.join(old.select(*on), on, "left_anti").dropDuplicates(on).select(old.columns))
            else:
                sets = dict(self._assignments(conflict[3]))
                a, b = old.alias(name), new.alias("excluded")
                hit = a.join(b, [F.col(f"{name}.{c}") == F.col(f"excluded.{c}") for c in on])
                merged = hit.select(*(F.expr(dialect.rewrite(re.sub(rf"(?<![\w.'])({'|'.join(old.columns)})(?![\w('])", rf"{name}.\1", sets[c]))).cast(k).alias(c) if c in sets else F.col(f"{name}.{c}") for c, k in old.dtypes))
                fresh = new.join(old, match, "left_anti")
                old = old.join(new.select(*on), on, "left_anti").select(old.columns)
                new = settled(merged.unionByName(fresh))
        total = old.unionByName(new)
        self._check_all(t, total)
        self._put(name, total, counters=tuple(counters.items()))
        return self._given(new, returning)

    def _assignments(self, s: str) -> list[tuple[str, str]]:
        out = []
        for p in split(tokens(s)):
            k = next(i for i, x in enumerate(p) if x.text == "=")
            out.append((text_of(p[:k]).strip().strip('"').lower(), text_of(p[k + 1 :]).strip()))
        return out

    def _changed(self, name: str, alias: str, other: str | None, where: str | None, sets: list[tuple[str, str]]) -> DataFrame:
        """The table's rows with _hit and, for those hit, the assigned values."""
        t = self.table(name)
        w = dialect.rewrite(self._functions(where)) if where else "true"
        cols = [(c, dialect.rewrite(self._functions(e))) for c, e in sets]
        view = f"_change_{uuid.uuid4().hex}"
        rows = settled(t.withColumn("_row", F.monotonically_increasing_id()))
        rows.createOrReplaceTempView(view)
        if other:
            self._views(other)
        values = ", ".join([f"CAST(({e}) AS {t.schema[c].dataType.simpleString()}) AS _new_{c}" for c, e in cols])
        hit = self.spark.sql(f"SELECT {alias}._row AS _hit{', ' + values if values else ''} FROM {view} {alias}{', ' + other if other else ''} WHERE {w}").dropDuplicates(["_hit"])
        joined = rows.join(hit, F.col("_row") == F.col("_hit"), "left")
        return joined

    def _update(self, s: str) -> DataFrame | None:
        s, returning = self._returning(s)
        m = re.match(r"(?is)^update\s+([\w.]+)(?:\s+(?:as\s+)?(?!set\b)(\w+))?\s+set\s+(.*)$", s)
        name, alias = m[1].lower(), m[2] or m[1]
        ts, parts = tokens(m[3]), {"set": [], "from": [], "where": []}
        at, depth = "set", 0
        for t in ts:
            depth += (t.text in "([") - (t.text in ")]") if t.kind == "op" else 0
            if not depth and t.low in ("from", "where") and at != "where":
                at = t.low
            else:
                parts[at].append(t)
        sets = self._assignments(text_of(parts["set"]))
        rows = settled(self._changed(name, alias, text_of(parts["from"]).strip() or None, text_of(parts["where"]).strip() or None, sets))
        new = dict(sets)
        df = self.table(name)
        out = rows.select(*(F.when(F.col("_hit").isNotNull(), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns), "_hit")
        self._check_all(self.state.tables[name], out)
        self._put(name, out.drop("_hit"))
        return self._given(out.where("_hit is not null").drop("_hit"), returning)

    def _delete(self, s: str) -> DataFrame | None:
        s, returning = self._returning(s)
        m = re.match(r"(?is)^delete\s+from\s+([\w.]+)(?:\s+(?:as\s+)?(?!using\b|where\b)(\w+))?(?:\s+using\s+(.*?))?(?:\s+where\s+(.*))?$", s)
        name = m[1].lower()
        rows = settled(self._changed(name, m[2] or m[1], m[3], m[4], []))
        before = self.state.tables[name]
        self._put(name, rows.where("_hit is null").select(before.df.columns))
        try:
            self._check_referenced(name)
        except SQLError:
            self.state.tables[name] = before
            raise
        return self._given(rows.where("_hit is not null").select(before.df.columns), returning)

    # --- transactions, settings, prepared statements

    def _begin(self, s: str) -> None:
        if self.saved:
            raise SQLError("a transaction is open")
        self.saved.append(("", self.state.copy()))

    def _commit(self, s: str) -> None:
        self.saved.clear()

    def _savepoint(self, s: str) -> None:
        if not self.saved:
            raise SQLError("no transaction is open")
        self.saved.append((significant(tokens(s))[-1].low, self.state.copy()))

    def _rollback(self, s: str) -> None:
        ws = [t.low for t in significant(tokens(s))]
        if not self.saved:
            raise SQLError("no transaction is open")
        if "to" in ws:
            while self.saved and self.saved[-1][0] != ws[-1]:
                self.saved.pop()
            if not self.saved:
                raise SQLError(f"no such savepoint: {ws[-1]}")
            self.state = self.saved[-1][1].copy()
        else:
            self.state = self.saved[0][1]
            self.saved.clear()

    def _release(self, s: str) -> None:
        name = significant(tokens(s))[-1].low
        self.saved = [x for x in self.saved if x[0] != name]

    def _set(self, s: str) -> None:
        m = re.match(r"(?is)^set\s+(?:session\s+|local\s+)?([\w.]+)\s*(?:=|to)\s*(.*)$", s)
        if m:
            self.settings[m[1].lower()] = m[2].strip().strip("'")

    def _show(self, s: str) -> DataFrame:
        name = significant(tokens(s))[-1].low
        rows = sorted(self.settings.items()) if name == "all" else [(name, self.settings.get(name))]
        return self.spark.createDataFrame(rows, "name string, setting string")

    def _reset(self, s: str) -> None:
        name = significant(tokens(s))[-1].low
        self.settings |= SETTINGS if name == "all" else {name: SETTINGS.get(name, "")}
        if s.lower().startswith("discard"):
            self.prepared.clear()

    def _prepare(self, s: str) -> None:
        m = re.match(r"(?is)^prepare\s+(\w+)\s*(?:\([^)]*\))?\s+as\s+(.*)$", s)
        self.prepared[m[1].lower()] = m[2]

    def _execute(self, s: str) -> DataFrame | None:
        m = re.match(r"(?is)^execute\s+(\w+)\s*(?:\((.*)\))?$", s)
        if m[1].lower() not in self.prepared:
            raise SQLError(f"no such prepared statement: {m[1]}")
        return self.sql(self.prepared[m[1].lower()], [literal(text_of(p)) for p in split(tokens(m[2]))] if m[2] else [])

    def _deallocate(self, s: str) -> None:
        name = significant(tokens(s))[-1].low
        self.prepared.clear() if name == "all" else self.prepared.pop(name, None)

    def _explain(self, s: str) -> DataFrame:
        df = self._run(re.sub(r"(?is)^explain\s+(analyze\s+)?", "", s))
        plan = df._jdf.queryExecution().toString() if df is not None else ""
        return self.spark.createDataFrame([(x,) for x in plan.split("\n")], "plan string")

    def _analyze(self, s: str) -> DataFrame:
        ws = significant(tokens(s))
        names = [ws[1].low] if len(ws) > 1 else sorted(self.state.tables)
        parts = [self.table(n).agg(F.lit(n).alias("table"), F.count("*").alias("rows")) for n in names]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    # --- queries

    def _functions(self, s: str) -> str:
        """nextval, currval, setval and lastval by their values."""
        def value(m):
            q = self.state.sequences.get(m[2].lower())
            if q is None:
                raise SQLError(f"no such sequence: {m[2]}")
            if m[1].lower() == "nextval":
                q["last"], q["next"] = q["next"], q["next"] + q["step"]
            elif m[1].lower() == "setval":
                q["last"] = int(m[3])
                q["next"] = q["last"] + q["step"]
            if q["last"] is None:
                raise SQLError(f"{m[2]} has no value yet")
            return str(q["last"])

        return re.sub(r"(?i)\b(nextval|currval|setval)\s*\(\s*'(\w+)'\s*(?:,\s*(-?\d+))?[^)]*\)", value, s)

    def _views(self, s: str, skip: str | None = None) -> None:
        """Temporary views of what a query names, stored views first resolved."""
        names = {t.low for t in tokens(s) if t.kind in ("word", "quoted")}
        for n in names & self.state.views.keys():
            self._select(self.state.views[n]).createOrReplaceTempView(n)
        for n in (names & self.state.tables.keys()) - {skip}:
            self.state.tables[n].df.createOrReplaceTempView(n)
        for n in names & self.foreign.keys():
            self.foreign[n].createOrReplaceTempView(n)
        if "information_schema" in names or any(n.startswith("pg_") for n in names):
            self._catalog()

    def _catalog(self) -> None:
        t = self.state.tables
        make = lambda rows, schema, name: self.spark.createDataFrame(rows, schema).createOrReplaceTempView(name)
        make([("public", n, "BASE TABLE") for n in t] + [("public", n, "VIEW") for n in self.state.views], "table_schema string, table_name string, table_type string", "information_schema_tables")
        make([("public", n, c, i + 1, k) for n, x in t.items() for i, (c, k) in enumerate(x.df.dtypes)], "table_schema string, table_name string, column_name string, ordinal_position int, data_type string", "information_schema_columns")
        make([("public", n) for n in t], "schemaname string, tablename string", "pg_tables")
        make([("public", n, d) for n, d in self.state.views.items()], "schemaname string, viewname string, definition string", "pg_views")
        make([("public", x[0], n, x[1]) for n, x in self.state.indexes.items()], "schemaname string, tablename string, indexname string, kind string", "pg_indexes")
        make([(k, v) for k, v in dialect.TYPES.items()], "typname string, spark string", "pg_type")

    def _select(self, s: str) -> DataFrame:
        s = self._functions(s)
        s = re.sub(r"(?i)\binformation_schema\.", "information_schema_", s)
        s = re.sub(r"(?i)\bpg_catalog\.", "", s)
        if re.match(r"(?is)^\s*values\b", s):
            n = len(split(tokens(s[s.index("(") + 1 : ])[: closing(tokens(s[s.index("(") :]), 0) - 1]))
            s = f"SELECT * FROM {s} AS t({', '.join(f'column{i + 1}' for i in range(n))})" if " order " not in s.lower() and " limit " not in s.lower() else s
        if m := re.search(r"(?is)\b(?:[a-z]+_)?facets\s*\(([^)]*)\)", s):
            cols = [c.strip().strip("'\"") for c in (m[1] or "").split(",") if c.strip()]
            rows = self._select(s[: m.start()] + "*" + s[m.end() :])
            return signals.facets(rows, *cols)
        s = self._table_functions(s)
        s = self._where(s)
        self._views(s + " information_schema" if "information_schema_" in s else s)
        whole: dict[str, bool] = {}
        for df in [*(t.df for t in self.state.tables.values()), *self.foreign.values()]:
            for c, kind in df.dtypes:
                whole[c.lower()] = whole.get(c.lower(), True) and kind in ("tinyint", "smallint", "int", "bigint")
        dialect.integers.set(frozenset(c for c, yes in whole.items() if yes))
        with_fns = dialect.rewrite(s)
        if m := re.search(r"(?is)^\s*with\s+recursive\b.*\bunion\b(?!\s+all)", with_fns):
            return self._recursive(with_fns)
        self.spark.addTag(self.tag)
        try:
            return self.spark.sql(with_fns)
        finally:
            self.spark.removeTag(self.tag)

    def _recursive(self, s: str) -> DataFrame:
        """WITH RECURSIVE name(cols) AS (first UNION step) query."""
        from weft.functions.scalar import recursive_union

        m = re.match(r"(?is)^\s*with\s+recursive\s+(\w+)\s*(?:\(([^)]*)\))?\s+as\s*\(", s)
        ts = tokens(s[m.end() - 1 :])
        end = closing(ts, 0)
        first, step = (text_of(p) for p in split(ts[1:end], "union"))
        cols = [c.strip() for c in m[2].split(",")] if m[2] else None
        base = self.spark.sql(first)
        base = base.toDF(*cols) if cols else base

        def run(new: DataFrame) -> DataFrame:
            new.createOrReplaceTempView(m[1])
            out = self.spark.sql(step)
            return out.toDF(*base.columns).select(*(F.col(c).cast(k).alias(c) for c, k in base.dtypes))

        recursive_union(base, run).createOrReplaceTempView(m[1])
        return self.spark.sql(text_of(ts[end + 1 :]))

    def _where(self, s: str) -> str:
        """Signal calls in WHERE become membership tests; the table they search gets _score, the sum of its signals' scores."""
        ts = tokens(s)
        low = [t.low for t in ts]
        starts = [i for i, w in enumerate(low) if w == "where"]
        calls = [i for i in range(starts[0], len(ts)) if ts[i].kind == "word" and low[i] in SIGNALS and next((t.text for t in ts[i + 1 :] if t.kind != "space"), "") == "("] if starts else []
        ats = [i for i in range(starts[0], len(ts)) if ts[i].text == "@@"] if starts else []
        if not calls and not ats:
            return s
        base, alias = self._searched(ts, calls, ats)
        made, scores, out, i = [], [], list(ts[: starts[0]]), starts[0]
        while i < len(ts):
            if i in calls:
                o = next(k for k in range(i + 1, len(ts)) if ts[k].text == "(")
                end = closing(ts, o)
                made.append(self.signal(text_of(ts[i : end + 1]), base))
                scores.append(not self._negated(ts, starts[0], i))
                out.append(Token("word", self._member(made[-1], alias or base)))
                i = end + 1
                continue
            nxt = next((k for k in range(i + 1, len(ts)) if ts[k].kind != "space"), None)
            if ts[i].kind == "word" and nxt is not None and ts[nxt].text == "@@":
                q = next(k for k in range(nxt + 1, len(ts)) if ts[k].kind == "string")
                made.append(self.match_query(base, None if low[i] == "_all" else low[i], literal(ts[q].text)))
                scores.append(not self._negated(ts, starts[0], i))
                while out and out[-1].text == "." or len(out) > 1 and out[-2].text == ".":  # the column's table
                    out.pop()
                if alias and out and out[-1].low == alias:
                    out.pop()
                out.append(Token("word", self._member(made[-1], alias or base)))
                i = q + 1
                continue
            out.append(ts[i])
            i += 1
        counted = [m for m, yes in zip(made, scores) if yes]
        score = signals.union(*counted) if len(counted) > 1 else counted[0] if counted else made[0].where("false")
        key = self.key(base)
        view = f"_scored_{uuid.uuid4().hex}"
        joined = self.table(base).join(score.withColumnRenamed(ID, "_sid"), F.col(key).cast("bigint") == F.col("_sid"), "left").drop("_sid")
        joined.withColumn(ID, F.col(key).cast("bigint")).createOrReplaceTempView(view)
        done, text_out = False, []
        for k, t in enumerate(out):  # the table's name in FROM, with its name as an alias unless it has one
            if not done and t.kind == "word" and t.low == base and k and any(x.low in ("from", "join") or x.text == "," for x in [y for y in out[:k] if y.kind != "space"][-1:]):
                after = next((x for x in out[k + 1 :] if x.kind != "space"), None)
                named = after is not None and after.kind == "word" and after.low not in ("where", "join", "inner", "left", "right", "full", "cross", "order", "group", "limit", "on", "union", "having")
                text_out.append(view + ("" if named else f" {base}"))
                done = True
            else:
                text_out.append(t.text)
        return "".join(text_out)

    def _member(self, s: DataFrame, base: str) -> str:
        view = f"_signal_{uuid.uuid4().hex}"
        s.select(ID).createOrReplaceTempView(view)
        return f"({base}.{ID} IN (SELECT {ID} FROM {view}))"

    def _negated(self, ts: list[Token], where: int, at: int) -> bool:
        """Whether the call at `at` stands under an odd number of NOTs."""
        odd, depths, before = False, [False], ""
        for t in ts[where + 1 : at]:
            if t.kind == "space":
                continue
            if t.text == "(":
                depths.append(depths[-1] != (before == "not"))
            elif t.text == ")":
                depths.pop()
            before = t.low
        odd = depths[-1] != (before == "not")
        return odd

    def _searched(self, ts: list[Token], calls: list[int], ats: list[int]) -> tuple[str, str | None]:
        """(table, alias) that the query's signals are about: the one that qualifies a signal's column, or else the first of FROM."""
        known, found = {**self.state.tables, **self.foreign}, []
        s = significant(ts)
        for k, t in enumerate(s):
            if t.kind in ("word", "quoted") and (n := t.text.strip('"').lower()) in known and k and (s[k - 1].low in ("from", "join") or s[k - 1].text == ","):
                after = s[k + 1 + (s[k + 1].low == "as")] if k + 2 < len(s) else None
                named = after is not None and after.kind == "word" and after.low not in ("where", "join", "inner", "left", "right", "full", "cross", "natural", "order", "group", "limit", "on", "using", "union", "having", "as")
                found.append((n, after.low if named else None))
        if not found:
            raise SQLError("a signal needs a table")
        for at in [*calls, *ats]:
            near = ts[at : at + 5] if at in calls else ts[max(0, at - 5) : at]
            for a, b in zip(significant(near), significant(near)[1:]):
                if b.text == ".":
                    for n, alias in found:
                        if a.low in (n, alias):
                            return n, alias
        return found[0]

    def match_query(self, base: str, column: str | None, query: str) -> DataFrame:
        """The signal of column @@ 'query'."""
        ix = self.index(base, [column] if column and column in dict(self.table(base).dtypes) and dict(self.table(base).dtypes)[column] == "string" else None)
        df, key = self.table(base), self.key(base)
        universe = signals.signal(df, key)

        def leaf(node):
            kind, f, value = node
            if kind == "vector":
                return vector.probability(vector.similarities(df, key, f, value))
            f = f or column
            return (text.phrase if kind == "phrase" else text.bayesian)(ix, value, f)

        return query_string.compile(query_string.parse(query), leaf, lambda ps: signals.intersect(*ps), lambda ps: signals.union(*ps), lambda p: signals.complement(p, universe), lambda ps: fusion.log_odds(ps))

    def signal(self, call: str, base: str, probability: bool = False) -> DataFrame:
        """The signal of one call; inside a fusion scores are probabilities."""
        ts = tokens(call)
        name = ts[0].low
        o = next(k for k, t in enumerate(ts) if t.text == "(")
        args = [text_of(p).strip() for p in split(ts[o + 1 : closing(ts, o)])] if significant(ts[o + 1 : closing(ts, o)]) else []
        named = {k.lower(): literal(v) for a in args if (m := re.match(r"(?is)^(\w+)\s*(?:=>|:=)\s*(.*)$", a)) for k, v in [m.groups()]}
        args = [a for a in args if not re.match(r"(?is)^\w+\s*(?:=>|:=)", a)]
        df, key = self.table(base), self.key(base)
        word = lambda a: a.strip("'\"").lower().rpartition(".")[2] if a else None
        is_signal = lambda a: (m := re.match(r"^(\w+)\s*\(", a)) and m[1].lower() in SIGNALS
        inner = lambda xs: [self.signal(a, base, True) for a in xs if is_signal(a)]
        g = lambda n=None: self.graph(n or base)
        if name in ("text_match", "bayesian_match"):
            column = None if word(args[0]) == "_all" else word(args[0])
            ix = self.index(base, [column] if column else None)
            return (text.bayesian if probability or name[0] == "b" else text.bm25)(ix, literal(args[1]), column)
        if name == "bayesian_match_with_prior":
            s = text.bayesian(self.index(base, [word(args[0])]), literal(args[1]), word(args[0]))
            c = F.col(word(args[2]))
            return text.with_prior(s, df, key, text.recency_prior(c) if literal(args[3]) == "recency" else text.authority_prior(c))
        if name == "multi_field_match":
            k = next(i for i, a in enumerate(args) if a.startswith("'"))
            weights = named.get("weights") or ([float(literal(a)) for a in args[k + 1 :]] or None)
            fields = [word(a) for a in args[:k]]
            return text.multi_field(self.index(base, fields), literal(args[k]), fields, weights)
        if name == "knn_match":
            s = vector.knn(df, key, word(args[0]), literal(args[1]), literal(args[2]))
            return vector.probability(s) if probability else s
        if name == "bayesian_knn_match":
            return vector.calibrated(df, key, word(args[0]), literal(args[1]), literal(args[2]), float(named.get("base_rate", 0.5)), named.get("weight_source", "distance_gap"), float(named.get("bandwidth_scale", 1.0)))
        if name == "vector_exclude":
            return vector.exclude(df, key, word(args[0]), literal(args[1]), literal(args[2]), literal(args[3]), float(literal(args[4])))
        if name == "spatial_within":
            p = df.select(F.col(key), F.col(word(args[0]))[0].alias("_x"), F.col(word(args[0]))[1].alias("_y"))
            return spatial.within(p, key, "_x", "_y", tuple(literal(args[1])), float(literal(args[2])))
        if name == "path_filter":
            op, value = (literal(args[1]), literal(args[2])) if len(args) > 2 else ("=", literal(args[1]))
            return signals.signal(nested.path_filter(df, literal(args[0]) if args[0][0] == "'" else args[0], value, op), key)
        if name == "traverse_match":
            return graph.traverse(g(), literal(args[0]), literal(args[2]) if len(args) > 2 else 1, literal(args[1]) if len(args) > 1 else None)
        if name == "temporal_traverse":
            times = [float(literal(a)) for a in args[3:5]]
            return graph.traverse(g().valid_at(times[0] if len(times) == 1 else tuple(times)), literal(args[0]), literal(args[2]), literal(args[1]))
        if name == "rpq":
            return graph.path_query(g(), literal(args[0]), literal(args[1])).select(ID, SCORE)
        if name == "weighted_rpq":
            return graph.weighted_path_query(g(), literal(args[0]), literal(args[1]), literal(args[2]), literal(args[3]) if len(args) > 3 else "sum", float(literal(args[4])) if len(args) > 4 else None)
        if name in ("pagerank", "hits", "betweenness"):
            own = next((literal(a) for a in args if a.startswith("'")), None)
            f = {"pagerank": graph.pagerank, "hits": graph.hits, "betweenness": graph.betweenness}[name]
            s = f(g(own), *([float(literal(args[0]))] if name == "pagerank" and args and not args[0].startswith("'") else []))
            return s.select(ID, SCORE)
        if name == "message_passing":
            prop = literal(args[2]) if len(args) > 2 else None
            value = F.try_element_at("properties", F.lit(prop)).cast("double") if prop else F.lit(0.0)
            return graph.message_passing(g(), value, literal(args[0]) if args else 2, literal(args[1]) if len(args) > 1 else "mean")
        if name == "sparse_threshold":
            return signals.threshold(self.signal(args[0], base, True), float(literal(args[1])))
        if name == "fuse_prob_not":
            return fusion.prob_not(self.signal(args[0], base, True), signals.signal(df, key))
        if name == "staged_retrieval":
            pairs = [(self.signal(a, base, True), literal(b)) for a, b in zip(args[::2], args[1::2])]
            return signals.staged(pairs[0][0], (None, pairs[0][1]), *pairs[1:])
        if name == "progressive_fusion":
            stages, own = [], []
            for a in args:
                if is_signal(a):
                    own.append(self.signal(a, base, True))
                elif re.fullmatch(r"\d+", a):
                    stages.append((own, int(a)))
                    own = []
            return fusion.progressive(stages, float(named.get("alpha", 0.5)), named.get("gating"))
        if name.startswith("fuse_"):
            parts, rest = inner(args), [literal(a) for a in args if not is_signal(a)]
            if len(parts) < 2:
                raise SQLError(f"{name} needs two signals")
            alpha = float(named.get("alpha", next((x for x in rest if isinstance(x, (int, float))), 0.5)))
            gating = named.get("gating", next((x for x in rest if isinstance(x, str)), None))
            if name == "fuse_log_odds":
                return fusion.log_odds(parts, alpha, gating, float(named.get("gating_beta", 1.0)))
            if name in ("fuse_prob_and", "fuse_prob_or"):
                return (fusion.prob_and if name.endswith("and") else fusion.prob_or)(parts)
            if name == "fuse_multihead":
                return fusion.multi_head(parts, [0.0] * 6, [None] * int(named.get("n_heads", 4)), alpha)
            return fusion.attention(parts, [0.0] * 6, None, alpha) if name == "fuse_attention" else fusion.Learned(len(parts)).fuse(parts)
        raise SQLError(f"no such signal: {name}")

    # --- graphs and table functions

    def graph(self, name: str) -> Graph:
        if name not in self.state.graphs:
            self.state.graphs[name] = Graph(self.spark.createDataFrame([], graph.VERTEX), self.spark.createDataFrame([], graph.EDGE))
        return self.state.graphs[name]

    def add_vertices(self, name: str, rows: list[tuple[int, str, dict]]) -> None:
        g = self.graph(name)
        new = self.spark.createDataFrame([(i, label, {k: str(v) for k, v in p.items()}) for i, label, p in rows], graph.VERTEX)
        self.state.graphs[name] = Graph(settled(g.vertices.join(new.select("id"), "id", "left_anti").unionByName(new)), g.edges)

    def add_edges(self, name: str, rows: list[tuple[int, int, int, str, dict]]) -> None:
        g = self.graph(name)
        new = self.spark.createDataFrame([(e, a, b, label, {k: str(v) for k, v in p.items()}) for e, a, b, label, p in rows], graph.EDGE)
        self.state.graphs[name] = Graph(g.vertices, settled(g.edges.join(new.select("edge_id"), "edge_id", "left_anti").unionByName(new)))

    def apply_delta(self, name: str, add_vertices=(), add_edges=(), drop_vertices=(), drop_edges=()) -> None:
        """Changes to a graph; dropping a vertex drops its edges. The graph before stays what it was: graphs are immutable."""
        g = self.graph(name)
        v = g.vertices.where(~F.col("id").isin(list(drop_vertices))) if drop_vertices else g.vertices
        e = g.edges.where(~F.col("edge_id").isin(list(drop_edges))) if drop_edges else g.edges
        if drop_vertices:
            e = e.where(~F.col("src").isin(list(drop_vertices)) & ~F.col("dst").isin(list(drop_vertices)))
        self.state.graphs[name] = Graph(settled(v), settled(e))
        if add_vertices:
            self.add_vertices(name, list(add_vertices))
        if add_edges:
            self.add_edges(name, list(add_edges))

    def _table_functions(self, s: str) -> str:
        """Table functions in FROM become views of their rows."""
        ts, out, i = tokens(s), [], 0
        while i < len(ts):
            before = next((t.low for t in reversed(out) if t.kind != "space"), "")
            nxt = next((k for k in range(i + 1, len(ts)) if ts[k].kind != "space"), None)
            if ts[i].kind == "word" and ts[i].low in TABLE_FUNCTIONS and nxt is not None and ts[nxt].text == "(" and before in ("from", "join", ","  , "select") and (before != "select" or ts[i].low.startswith(("create_", "drop_", "graph_", "build_", "set_", "list_"))) and (before != "," or any(t.low == "from" for t in out)) and not any(t.low == "where" for t in out):
                end = closing(ts, nxt)
                args = [text_of(p).strip() for p in split(ts[nxt + 1 : end])] if significant(ts[nxt + 1 : end]) else []
                tail = text_of(ts[end + 1 :])
                view = f"_rows_{uuid.uuid4().hex}"
                columns = re.match(r"(?is)^\s+as\s*\(([^)]*)\)|^\s+as\s+\w+\s*\(([^)]*)\)", tail) if ts[i].low == "cypher" else None
                df = self._rows(ts[i].low, args)
                if columns:
                    named = [c.split() for c in (columns[1] or columns[2]).split(",")]
                    df = df.toDF(*(c[0] for c in named))
                    df = df.select(*(F.col(c[0]).cast(dialect.TYPES[c[1].lower()]).alias(c[0]) if len(c) > 1 and c[1].lower() in dialect.TYPES else F.col(c[0]) for c in named))
                    end += len(tokens(tail[: columns.end()]))
                df.createOrReplaceTempView(view)
                out.append(Token("word", f"* FROM {view}" if before == "select" else view + ("" if re.match(r"(?is)^\s+(as\s+)?(?!where|order|limit|join|group|on\b|left|inner|cross)\w+", text_of(ts[end + 1 :])) else f" {ts[i].low}")))
                i = end + 1
                continue
            out.append(ts[i])
            i += 1
        return text_of(out)

    def _rows(self, name: str, args: list[str]) -> DataFrame:
        spark = self.spark
        v = [literal(a) if not re.match(r"(?i)^(array|point)?\s*[\[(]", a) else literal(a) for a in args if re.match(r"(?is)^(['$\-+\d]|array|point|true|false|null|\[)", a)]
        if name == "generate_series":
            if len(v) > 2 and v[2] == 0:
                raise SQLError("step 0")
            return spark.sql(f"SELECT explode(sequence({v[0]}, {v[1]}, {v[2] if len(v) > 2 else 1})) AS generate_series") if not (len(v) < 3 and v[0] > v[1]) else spark.sql("SELECT 1 AS generate_series WHERE false")
        if name == "unnest":
            return spark.sql(f"SELECT explode({dialect.rewrite(args[0])}) AS unnest")
        if name == "regexp_split_to_table":
            flags = f"(?{v[2]})" if len(v) > 2 else ""
            return spark.createDataFrame([(v[0],)], "s string").select(F.explode(F.split("s", flags + v[1])).alias("regexp_split_to_table"))
        if "json" in name and "each" in name:
            return spark.createDataFrame([(v[0],)], "s string").select(F.explode(F.from_json("s", "map<string,string>")).alias("key", "value"))
        if "json" in name:
            return spark.createDataFrame([(v[0],)], "s string").select(F.explode(F.from_json("s", "array<string>")).alias("value"))
        if name == "text_search":
            table = v[2] if len(v) > 2 else next(iter(self.state.tables))
            return signals.attach(self.table(table), text.bm25(self.index(table, [v[1]] if v[1] else None), v[0], v[1] or None), self.key(table))
        if name in ("traverse", "temporal_traverse", "rpq", "pagerank", "hits", "betweenness"):
            own = self.graph(next((x for x in v[1:] if isinstance(x, str) and x in self.state.graphs), v[0] if v and isinstance(v[0], str) and v[0] in self.state.graphs else next(iter(self.state.graphs), "")))
            if name == "traverse":
                s = graph.traverse(own, v[0], v[2], v[1])
            elif name == "temporal_traverse":
                times = [float(x) for x in v[3:5] if isinstance(x, (int, float))]
                s = graph.traverse(own.valid_at(times[0] if len(times) == 1 else tuple(times)), v[0], v[2], v[1])
            elif name == "rpq":
                s = graph.path_query(own, v[0], v[1])
            else:
                s = {"pagerank": graph.pagerank, "hits": graph.hits, "betweenness": graph.betweenness}[name](own)
            return own.vertices.join(s.withColumnRenamed(ID, "id"), "id")
        if name == "cypher":
            from weft.cypher import Cypher

            c = Cypher(self.graph(v[0]), v[2] if len(v) > 2 else None)
            rows = c.run(v[1])
            self.state.graphs[v[0]] = c.graph
            return rows
        done = lambda what: spark.createDataFrame([(what,)], f"{name} string")
        if name in ("create_graph", "graph_create"):
            self.graph(v[0])
            return done(v[0])
        if name in ("drop_graph", "graph_drop"):
            self.state.graphs.pop(v[0], None)
            return done(v[0])
        if name == "graph_add_vertex":
            self.add_vertices(v[2], [(v[0], v[1], json.loads(v[3]) if len(v) > 3 else {})])
            return done(str(v[0]))
        if name == "graph_add_edge":
            self.add_edges(v[4], [(v[0], v[1], v[2], v[3], json.loads(v[5]) if len(v) > 5 else {})])
            return done(str(v[0]))
        if name == "graph_create_node":
            new = (self.graph(v[0]).vertices.agg(F.max("id")).first()[0] or 0) + 1
            self.add_vertices(v[0], [(new, v[1], json.loads(v[2]) if len(v) > 2 and v[2] else {})])
            return done(f"{v[0]}:{v[1]}:{new}")
        if name == "graph_create_edge":
            new = (self.graph(v[0]).edges.agg(F.max("edge_id")).first()[0] or 0) + 1
            end = lambda x: int(str(x).rpartition(":")[2])
            self.add_edges(v[0], [(new, end(v[2]), end(v[3]), v[1], json.loads(v[4]) if len(v) > 4 and v[4] else {})])
            return done(f"{v[0]}:{v[1]}:{new}")
        if name == "graph_nodes":
            g = self.graph(v[0]).vertices
            g = g.where(F.col("label") == v[1]) if len(v) > 1 and v[1] else g
            for k, x in (json.loads(v[2]) if len(v) > 2 and v[2] else {}).items():
                g = g.where(F.try_element_at("properties", F.lit(k)) == str(x))
            return g.select("id", "label", F.to_json("properties").alias("properties"))
        if name == "graph_edges":
            g = self.graph(v[0]).edges
            if len(v) > 1 and isinstance(v[1], int):
                d = v[3] if len(v) > 3 and v[3] else "out"
                g = g.where({"out": F.col("src") == v[1], "in": F.col("dst") == v[1]}.get(d, (F.col("src") == v[1]) | (F.col("dst") == v[1])))
                g = g.where(F.col("label") == v[2]) if len(v) > 2 and v[2] else g
            elif len(v) > 1 and v[1]:
                g = g.where(F.col("label") == v[1])
            return g.select(F.col("edge_id").alias("id"), F.col("src").alias("source_id"), F.col("dst").alias("target_id"), "label", F.to_json("properties").alias("properties"))
        if name in ("graph_neighbors", "graph_traverse"):
            labels = tuple(x.strip() for x in v[2].split(",")) if len(v) > 2 and v[2] else ()
            d = {"outgoing": "out", "incoming": "in"}.get(v[3], v[3]) if len(v) > 3 and v[3] else "out"
            got = graph.neighbours(self.graph(v[0]), v[1], v[4] if len(v) > 4 else 1, labels, d)
            return got.withColumn("properties", F.to_json("properties"))
        if name == "graph_delete_node":
            self.apply_delta(v[0], drop_vertices=[int(str(v[1]).rpartition(":")[2])])
            return done(str(v[1]))
        if name == "graph_delete_edge":
            self.apply_delta(v[0], drop_edges=[int(str(v[1]).rpartition(":")[2])])
            return done(str(v[1]))
        if name == "build_grid_graph":
            self.state.graphs[v[0]] = graph.grid(spark, v[1], v[2], v[3] if len(v) > 3 else "next")
            return done(v[0])
        if name == "create_analyzer":
            analysis.create(v[0], v[1])
            return done(v[0])
        if name == "drop_analyzer":
            analysis.drop(v[0])
            return done(v[0])
        if name == "list_analyzers":
            return spark.createDataFrame([(n,) for n in analysis.names()], "analyzer_name string")
        if name == "set_table_analyzer":
            t = self.state.tables[v[0]]
            self.state.tables[v[0]] = replace(t, fields=tuple((dict(t.fields) | {v[1]: v[2]}).items()))
            return done(v[2])
        raise SQLError(f"no such table function: {name}")
