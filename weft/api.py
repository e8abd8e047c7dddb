"""The fluent builder: each step returns a new query; nothing runs before execute()."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft import sources
from weft.operators import fusion, graph, nested, signals, text, vector
from weft.operators.graph import EdgePattern
from weft.operators.signals import ID, SCORE


@dataclass(frozen=True)
class Query:
    """A table of a session with a current signal (all of its rows, unscored, at first), signals held for a fusion, and a
    projection of the rows."""

    session: object
    name: str
    current: DataFrame | None = None
    held: tuple[DataFrame, ...] = ()
    rows: DataFrame | None = None
    plan: tuple[str, ...] = field(default=())

    # --- what the steps share

    @property
    def base(self) -> DataFrame:
        return self.rows if self.rows is not None else self.session.table(self.name)

    @property
    def key(self) -> str:
        return self.session.key(self.name)

    def universe(self) -> DataFrame:
        return signals.signal(self.session.table(self.name), self.key)

    def signal(self) -> DataFrame:
        return self.current if self.current is not None else self.universe()

    def _with(self, s: DataFrame, step: str) -> Query:
        """A further signal: it joins the current one by AND, and is held for a fusion."""
        now = s if self.current is None else signals.intersect(self.current, s)
        return replace(self, current=now, held=(*self.held, s), plan=(*self.plan, step))

    def _set(self, s: DataFrame, step: str) -> Query:
        return replace(self, current=s, plan=(*self.plan, step))

    def index(self, columns: list[str] | None = None) -> text.Index:
        return self.session.index(self.name, columns)

    # --- signals

    def term(self, query: str, column: str | None = None) -> Query:
        return self._with(text.term(self.index([column] if column else None), query, column), f"term({query})")

    def vector(self, query: list[float], threshold: float, column: str) -> Query:
        return self._with(vector.within(self.session.table(self.name), self.key, column, query, threshold), f"vector >= {threshold}")

    def knn(self, query: list[float], k: int, column: str) -> Query:
        return self._with(vector.knn(self.session.table(self.name), self.key, column, query, k), f"knn({k})")

    def bayesian_knn(self, query: list[float], k: int, column: str, **options) -> Query:
        return self._with(vector.calibrated(self.session.table(self.name), self.key, column, query, k, **options), f"bayesian_knn({k})")

    def and_(self, other: Query) -> Query:
        return replace(self._set(signals.intersect(self.signal(), other.signal()), "and"), held=(*self.held, *other.held))

    def or_(self, other: Query) -> Query:
        return replace(self._set(signals.union(self.signal(), other.signal()), "or"), held=(*self.held, *other.held))

    def not_(self) -> Query:
        return self._set(signals.complement(self.signal(), self.universe()), "not")

    def filter(self, condition: str | Column) -> Query:
        rows = self.session.table(self.name).where(condition).select(F.col(self.key).cast("bigint").alias(ID))
        return self._set(self.signal().join(rows, ID, "left_semi"), f"filter({condition})")

    def traverse(self, start: int, label: str | None = None, hops: int = 1) -> Query:
        return self._with(graph.traverse(self.session.graph(self.name), start, hops, label), f"traverse({start}, {hops})")

    def temporal_traverse(self, start: int, label: str | None, hops: int, at: float | tuple[float, float]) -> Query:
        return self._with(graph.traverse(self.session.graph(self.name).valid_at(at), start, hops, label), f"temporal_traverse({start}, {at})")

    def match_pattern(self, vertices: dict[str, str | None], edges: list[EdgePattern]) -> Query:
        """The signal of vertices bound to the pattern's first variable."""
        m = graph.match(self.session.graph(self.name), vertices, edges)
        return self._with(signals.signal(m.select(next(iter(vertices))).distinct(), next(iter(vertices)), 1.0), "match_pattern")

    def rpq(self, expression: str, start: int) -> Query:
        return self._with(graph.path_query(self.session.graph(self.name), expression, start).select(ID, SCORE), f"rpq({expression})")

    def vertex_aggregate(self, prop: str, how: str = "sum") -> DataFrame:
        return graph.vertex_aggregate(self.session.graph(self.name), self.signal(), prop, how)

    def vector_exclude(self, negative: list[float], threshold: float, column: str) -> Query:
        return self._set(signals.difference(self.signal(), vector.within(self.session.table(self.name), self.key, column, negative, threshold)), "vector_exclude")

    def sparse_threshold(self, threshold: float) -> Query:
        return self._set(signals.threshold(self.signal(), threshold), f"sparse_threshold({threshold})")

    def message_passing(self, rounds: int = 2, how: str = "mean", prop: str | None = None) -> Query:
        value = F.try_element_at("properties", F.lit(prop)).cast("double") if prop else F.lit(0.0)
        return self._with(graph.message_passing(self.session.graph(self.name), value, rounds, how), f"message_passing({rounds})")

    # --- scores and fusions

    def score_bm25(self, query: str, column: str | None = None) -> Query:
        return self._scored(text.bm25(self.index([column] if column else None), query, column), "bm25")

    def score_bayesian_bm25(self, query: str, column: str | None = None) -> Query:
        return self._scored(text.bayesian(self.index([column] if column else None), query, column), "bayesian_bm25")

    def score_multi_field_bayesian(self, query: str, columns: list[str], weights: list[float] | None = None) -> Query:
        return self._scored(text.multi_field(self.index(columns), query, columns, weights), "multi_field")

    def score_bayesian_with_prior(self, query: str, column: str, prior: Column) -> Query:
        s = text.with_prior(text.bayesian(self.index([column]), query, column), self.session.table(self.name), self.key, prior)
        return self._scored(s, "bayesian_with_prior")

    def _scored(self, s: DataFrame, step: str) -> Query:
        """The current documents with the scores of s: those it lacks go."""
        now = s if self.current is None else s.join(self.current.select(ID), ID, "left_semi")
        return replace(self, current=now, held=(*self.held, s), plan=(*self.plan, step))

    def learn_params(self, query: str, labels: DataFrame, column: str) -> dict:
        return self.session.learn_scoring_params(self.name, column, query, labels)

    def _fused(self, s: DataFrame, step: str) -> Query:
        return replace(self, current=s, held=(), plan=(*self.plan, step))

    def fuse_log_odds(self, alpha: float = 0.5, gating: str | None = None) -> Query:
        return self._fused(fusion.log_odds(list(self.held), alpha, gating), "fuse_log_odds")

    def fuse_prob_and(self) -> Query:
        return self._fused(fusion.prob_and(list(self.held)), "fuse_prob_and")

    def fuse_prob_or(self) -> Query:
        return self._fused(fusion.prob_or(list(self.held)), "fuse_prob_or")

    def fuse_attention(self, alpha: float = 0.5) -> Query:
        return self._fused(fusion.attention(list(self.held), [0.0] * 6, None, alpha), "fuse_attention")

    def fuse_learned(self, alpha: float = 0.0, weights: list[float] | None = None) -> Query:
        learned = fusion.Learned(len(self.held), alpha)
        learned.weights = weights or learned.weights
        return self._fused(learned.fuse(list(self.held)), "fuse_learned")

    def multi_stage(self, stages: list[tuple[Query | None, int | float]]) -> Query:
        return self._set(signals.staged(self.signal(), *((q.signal() if q else None, cut) for q, cut in stages)), "multi_stage")

    # --- joins, aggregates, facets, nested records

    def join(self, other: Query, left: str, right: str, how: str = "inner") -> DataFrame:
        a, b = self.execute().alias("l"), other.execute().alias("r")
        return a.join(b, F.col(f"l.{left}") == F.col(f"r.{right}"), how)

    def vector_join(self, other: Query, left: str, right: str, threshold: float) -> DataFrame:
        return vector.join(self.execute(), other.execute(), (self.key, left), (other.key, right), threshold)

    def aggregate(self, column: str, how: str = "count", q: float | None = None) -> DataFrame:
        agg = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}.get(how, lambda c: F.percentile(c, F.lit(q if q is not None else 0.5)))
        return self.execute().agg(agg(F.col(column)).alias(how))

    def group_by(self, column: str, value: str, how: str = "count") -> DataFrame:
        agg = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[how]
        return self.execute().where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias(column)).agg(agg(F.col(value)).alias(how))

    def facet(self, *columns: str) -> DataFrame:
        return signals.facets(self.execute(), *columns)

    def vector_facet(self, column: str, query: list[float], threshold: float, by: str) -> DataFrame:
        return self.vector(query, threshold, column).facet(by)

    def path_filter(self, path: str, value, op: str = "=") -> Query:
        return self._set(self.signal().join(signals.signal(nested.path_filter(self.session.table(self.name), path, value, op), self.key).select(ID), ID, "left_semi"), f"path_filter({path})")

    def path_project(self, *paths: str) -> DataFrame:
        return nested.path_project(self.execute(), *paths)

    def unnest(self, path: str) -> DataFrame:
        return nested.path_unnest(self.execute(), path)

    def path_aggregate(self, path: str, how: str) -> DataFrame:
        return nested.path_aggregate(self.execute(), path, how)

    # --- results

    def top(self, k: int) -> Query:
        return self._set(signals.top_k(self.signal(), k), f"top({k})")

    def execute(self) -> DataFrame:
        """The table's rows of the current signal, with _score."""
        if self.current is None:
            return self.base.withColumn(SCORE, F.lit(0.0))
        return signals.attach(self.base, self.current, self.key)

    def execute_arrow(self):
        return self.execute().toArrow()

    def execute_parquet(self, path: str) -> None:
        sources.write(self.execute(), path)

    def explain(self) -> str:
        return " -> ".join((self.name, *self.plan))
