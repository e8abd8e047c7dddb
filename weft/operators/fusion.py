"""Fusion of probability signals: log-odds conjunctions, probabilistic AND, OR and NOT, adaptive, attention and learned weights."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.signals import ID, SCORE, top_k

LEAST = 1e-15


def clip(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(LEAST)), F.lit(1 - LEAST))


def logit(p: Column) -> Column:
    p = clip(p)
    return F.ln(p / (1 - p))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def gate(x: Column, kind: str | None, beta: float = 1.0) -> Column:
    if kind in (None, "none"):
        return x
    if kind == "relu":
        return F.greatest(x, F.lit(0.0))
    if kind == "swish":
        return x * sigmoid(x * beta)
    raise ValueError(f"no such gating: {kind}")


def coverage_default(hits: int, total: int) -> float:
    """What a missing score counts as: near .5 for a signal that covers little, near .01 for one that covers all."""
    r = hits / total if total else 0.0
    return 0.5 * (1 - r) + 0.01 * r


def wide(signals: list[DataFrame], defaults: list[float] | None = None) -> DataFrame:
    """(_doc_id, _p0, _p1, ...): every document of any signal; the coverage default, or the given one, where a signal lacks it.

    One aggregate over the union instead of a chain of outer joins, and one more for the counts that the defaults need."""
    tagged = reduce(DataFrame.unionByName, [s.select(ID, SCORE, F.lit(i).alias("_of")) for i, s in enumerate(signals)])
    table = tagged.groupBy(ID).agg(*(F.max(F.when(F.col("_of") == i, F.col(SCORE))).alias(f"_p{i}") for i in range(len(signals))))
    if defaults is None:
        from weft.operators.graph import settled

        table = settled(table)  # read for the counts and for the scores
        n = table.agg(F.count("*").alias("n"), *(F.count(f"_p{i}").alias(f"c{i}") for i in range(len(signals)))).first()
        defaults = [coverage_default(n[f"c{i}"], n["n"]) for i in range(len(signals))]
    return table.select(ID, *(F.coalesce(f"_p{i}", F.lit(d)).alias(f"_p{i}") for i, d in enumerate(defaults)))


def _total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def log_odds(signals: list[DataFrame], alpha: float = 0.5, gating: str | None = None, beta: float = 1.0, weights: list[float] | None = None, defaults: list[float] | None = None) -> DataFrame:
    """sigmoid(n^alpha x mean of logits); with weights sigmoid(sum of w x logit), w scaled to sum 1."""
    n = len(signals)
    w = [x / sum(weights) for x in weights] if weights else [1 / n] * n
    logits = [gate(logit(F.col(f"_p{i}")), gating, beta) * w[i] for i in range(n)]
    return wide(signals, defaults).select(ID, sigmoid(_total(logits) * (1.0 if weights else n**alpha)).alias(SCORE))


def prob_and(signals: list[DataFrame], defaults: list[float] | None = None) -> DataFrame:
    return wide(signals, defaults).select(ID, reduce(lambda a, b: a * b, [F.col(f"_p{i}") for i in range(len(signals))]).alias(SCORE))


def prob_or(signals: list[DataFrame], defaults: list[float] | None = None) -> DataFrame:
    return wide(signals, defaults).select(ID, (1 - reduce(lambda a, b: a * b, [1 - F.col(f"_p{i}") for i in range(len(signals))])).alias(SCORE))


def prob_not(signal: DataFrame, universe: DataFrame, absent: float = 0.01) -> DataFrame:
    """1 - p over the universe; a document that the signal lacks counts as `absent`."""
    return universe.select(ID).join(signal, ID, "left").select(ID, (1 - F.coalesce(SCORE, F.lit(absent))).alias(SCORE))


def adaptive(signals: list[DataFrame], base: float = 0.5) -> DataFrame:
    """Log-odds weighted by each signal's confidence: its coverage, variance and distance of the mean from .5."""
    table = wide(signals)
    columns = [f"_p{i}" for i in range(len(signals))]
    n = reduce(DataFrame.unionByName, [s.select(F.lit(i).alias("i"), SCORE) for i, s in enumerate(signals)]).groupBy("i").agg(F.count("*").alias("n"), F.var_pop(SCORE).alias("v"), F.avg(SCORE).alias("m"))
    stats = {r.i: (r.n, r.v or 0.0, r.m) for r in n.collect()}  # one row a signal
    total = table.count()
    alphas = [min(1.0, max(0.01, base * (s[0] / total if total else 0) * (1 + s[1]) * (0.5 + abs(s[2] - 0.5)))) if (s := stats.get(i)) else 0.01 for i in range(len(signals))]
    w = [a / sum(alphas) for a in alphas]
    return table.select(ID, sigmoid(_total([logit(F.col(c)) * x for c, x in zip(columns, w)]) * len(signals) ** base).alias(SCORE))


def attention_weights(features: list[float], n_signals: int, matrix: list[list[float]] | None = None) -> list[float]:
    """softmax(W x features); without a trained W all signals weigh the same."""
    z = np.array(matrix) @ np.array(features) if matrix is not None else np.zeros(n_signals)
    e = np.exp(z - z.max())
    return (e / e.sum()).tolist()


def attention(signals: list[DataFrame], features: list[float], matrix: list[list[float]] | None = None, alpha: float = 0.5) -> DataFrame:
    w = attention_weights(features, len(signals), matrix)
    return wide(signals).select(ID, sigmoid(_total([logit(F.col(f"_p{i}")) * x for i, x in enumerate(w)]) * len(signals) ** alpha).alias(SCORE))


def multi_head(signals: list[DataFrame], features: list[float], matrices: list[list[list[float]] | None], alpha: float = 0.5) -> DataFrame:
    """The mean over heads of their log-odds."""
    heads = [attention_weights(features, len(signals), m) for m in matrices]
    w = np.mean(heads, 0).tolist()
    return wide(signals).select(ID, sigmoid(_total([logit(F.col(f"_p{i}")) * x for i, x in enumerate(w)]) * len(signals) ** alpha).alias(SCORE))


class Learned:
    """Per-signal weights fitted to labels by gradient descent on the log loss of their weighted log-odds."""

    def __init__(self, n: int, alpha: float = 0.0):
        self.weights, self.alpha = [1 / n] * n, alpha

    def fuse(self, signals: list[DataFrame]) -> DataFrame:
        scale = len(signals) ** self.alpha
        return wide(signals).select(ID, sigmoid(_total([logit(F.col(f"_p{i}")) * (w * scale) for i, w in enumerate(self.weights)])).alias(SCORE))

    def fit(self, signals: list[DataFrame], labels: DataFrame, rounds: int = 50, rate: float = 0.1) -> Learned:
        """labels: (_doc_id, label in 0, 1). The gradient of a round is one aggregate; only it reaches the driver."""
        table = wide(signals).join(labels.select(ID, F.col("label").cast("double").alias("_y")), ID)
        x = [logit(F.col(f"_p{i}")) for i in range(len(signals))]
        table = table.select(*(c.alias(f"x{i}") for i, c in enumerate(x)), "_y").cache()
        for _ in range(rounds):
            p = sigmoid(_total([F.col(f"x{i}") * w for i, w in enumerate(self.weights)]))
            g = table.agg(*(F.avg((p - F.col("_y")) * F.col(f"x{i}")) for i in range(len(x)))).first()
            if g[0] is None:
                break
            self.weights = [w - rate * d for w, d in zip(self.weights, g)]
        table.unpersist()
        return self

    def state(self) -> dict:
        return {"weights": self.weights, "alpha": self.alpha}


def progressive(stages: list[tuple[list[DataFrame], int]], alpha: float = 0.5, gating: str | None = None) -> DataFrame:
    """Each stage adds signals, fuses all so far over the survivors, and keeps its k best."""
    own: list[DataFrame] = []
    kept: DataFrame | None = None
    for signals, k in stages:
        own += signals
        now = own if kept is None else [s.join(kept.select(ID), ID, "left_semi") for s in own]
        kept = top_k(log_odds(now, alpha, gating) if len(now) > 1 else now[0], k)
    return kept


def sigma(x: float) -> float:
    return 1 / (1 + math.exp(-x))
