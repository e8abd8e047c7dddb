"""Layered models over a graph of nodes with channel vectors, and their analytic training.

A layer's state is a DataFrame (_doc_id, channels ARRAY<DOUBLE>). Layers that need all nodes at once (attention, greedy pooling)
run as one group and say so; others are joins, aggregates and Arrow batches. Training solves ridge regression from sums of
products that the cluster adds up, so only matrices of the size of the model reach the driver.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.fusion import wide
from weft.operators.graph import Graph, settled, steps
from weft.operators.packed import WINDOW, Packed, pack, spread
from weft.operators.signals import ID, SCORE

STATE = f"{ID} bigint, channels array<double>"


def _sig(x):
    return 1 / (1 + np.exp(-x))


def _logit(p):
    p = np.clip(p, 1e-15, 1 - 1e-15)
    return np.log(p / (1 - p))


def gate(x: np.ndarray, kind: str | None) -> np.ndarray:
    return np.maximum(x, 0) if kind == "relu" else x * _sig(x) if kind == "swish" else np.tanh(x) if kind == "tanh" else x


def _rows(state: DataFrame, f) -> DataFrame:
    """f over each batch's matrix of channels."""

    def run(batches):
        for batch in batches:
            if len(batch):
                x = f(np.array(batch["channels"].to_pylist(), np.float64))
                yield pa.record_batch([batch[ID], pa.array(list(x), pa.list_(pa.float64()))], [ID, "channels"])

    return state.select(ID, "channels").mapInArrow(run, STATE)


def embed(docs: DataFrame, doc_id: str, column: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("bigint").alias(ID), F.col(column).cast("array<double>").alias("channels")).where("channels is not null")


def from_signals(signals: list[DataFrame]) -> DataFrame:
    """A first layer: one channel, the log-odds conjunction of the signals, as a probability."""
    n = len(signals)
    x = F.array(*(F.col(f"_p{i}") for i in range(n)))
    return _rows(wide(signals).select(ID, x.alias("channels")), lambda p: _sig(_logit(p).mean(1, keepdims=True) * math.sqrt(n)))


def add_signals(state: DataFrame, signals: list[DataFrame]) -> DataFrame:
    """A layer of signals: its log-odds are added to those of channel 0; nodes of either side are kept."""
    new = from_signals(signals).withColumnRenamed("channels", "_new")
    both = state.join(new, ID, "full").select(ID, F.coalesce("channels", F.array(F.lit(0.5))).alias("channels"), F.coalesce(F.element_at("_new", 1), F.lit(0.5)).alias("_p"))
    joined = both.select(ID, F.concat(F.array("_p"), "channels").alias("channels"))
    return _rows(joined, lambda x: np.concatenate([_sig(_logit(x[:, 1:2]) + _logit(x[:, :1])), x[:, 2:]], 1))


def _exploded(state: DataFrame) -> DataFrame:
    return state.select(ID, F.posexplode("channels").alias("i", "x"))


def _collected(df: DataFrame, key: str = ID) -> DataFrame:
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("c")).select(F.col(key).alias(ID), F.transform("c", lambda e: e["x"]).alias("channels"))


def _packed(state: DataFrame, g: Graph, label: str | None) -> tuple[Packed, int] | None:
    """The graph packed over the state's nodes with their channels as vectors, and how many channels there are."""
    state = settled(state)  # read for its size, for the ranges of its ids and for its channels
    row = state.select(F.size("channels").alias("n")).first()
    if row is None or row.n < 1:
        return None
    nodes = state.select(F.col(ID).alias("id"), "channels")
    p = pack(nodes, g.labelled(label), ("out", "in"), values={f"c{i}": F.col("channels")[i] for i in range(row.n)})
    return p and (p, row.n)


def _with_near(p: Packed, channels: int, sides: tuple[str, ...], own: bool, how: str, f) -> DataFrame:
    """f of each node's channels, of those of its different neighbours (aggregated, itself among them only with `own`), and of
    whether it has any; a range of nodes at a time."""

    def run(a: int, b: int):
        offs = [p.side(s) for s in sides]
        while a < b:
            # as many nodes as have WINDOW edges, one at least
            e = max(a + 1, min(b, *(int(np.searchsorted(off[a : b + 1], int(off[a]) + WINDOW, "right")) + a - 1 for off, _ in offs)))
            pairs = []
            for off, to in offs:
                of, at = spread(off, np.arange(a, e))
                pairs.append(of * p.n + to[at])
            pairs = np.unique(np.concatenate(pairs))
            of, near = pairs // p.n, pairs % p.n
            if not own:
                of, near = of[of + a != near], near[of + a != near]
            n = np.bincount(of, minlength=e - a)
            x, m = np.empty((e - a, channels)), np.zeros((e - a, channels))
            for i in range(channels):
                c = p.open(f"c{i}")
                x[:, i] = c[a:e]
                if how == "max":
                    k = np.flatnonzero(n)
                    m[k, i] = np.maximum.reduceat(c[near], (np.cumsum(n) - n)[k]) if len(k) else 0.0
                else:
                    m[:, i] = np.bincount(of, c[near], e - a) / (np.maximum(n, 1) if how == "mean" else 1)
            out = f(x, m, n > 0)
            yield [np.asarray(p.ids[a:e]), pa.ListArray.from_arrays(np.arange(0, (e - a) * channels + 1, channels, dtype=np.int32), out.ravel())]
            a = e

    from pyspark.sql import SparkSession

    return p.run(SparkSession.active(), run, STATE, sides[0])


def propagate(state: DataFrame, g: Graph, label: str | None = None, how: str = "mean", direction: str = "both") -> DataFrame:
    """Neighbours' channels, aggregated, added to each node's own in log-odds."""
    if got := _packed(state, g, label):
        sides = {"out": ("out",), "in": ("in",), "both": ("out", "in")}[direction]
        return _with_near(*got, sides, True, how, lambda x, m, some: _sig(_logit(x) + _logit(np.where(some[:, None], m, 0.5))))
    agg = {"mean": F.avg, "sum": F.sum, "max": F.max}[how]
    near = steps(g.labelled(label), direction).select("a", "b").distinct().join(_exploded(state), F.col("b") == F.col(ID))
    m = _collected(near.groupBy("a", "i").agg(agg("x").alias("x")), "a").withColumnRenamed("channels", "_m")
    joined = state.join(m, ID, "left").select(ID, F.concat("channels", F.coalesce("_m", F.transform("channels", lambda _: F.lit(0.5)))).alias("channels"))
    return _rows(joined, lambda x: _sig(_logit(x[:, : x.shape[1] // 2]) + _logit(x[:, x.shape[1] // 2 :])))


def _rings(g: Graph, state: DataFrame, most: int, label: str | None) -> DataFrame:
    """(a, b, d): nodes b at distance d of a, 0 to `most`."""
    along = settled(steps(g.labelled(label), "both").select("a", "b").distinct())
    rings = settled(state.select(F.col(ID).alias("a"), F.col(ID).alias("b"), F.lit(0).alias("d")))
    last = rings
    for d in range(1, most + 1):
        nxt = last.select(F.col("a"), F.col("b").alias("m")).join(along.select(F.col("a").alias("m"), "b"), "m").select("a", "b").distinct()
        last = settled(nxt.join(rings.select("a", "b"), ["a", "b"], "left_anti").withColumn("d", F.lit(d)))
        rings = rings.unionByName(last)
    return rings


def convolve(state: DataFrame, g: Graph, weights: list[float], label: str | None = None) -> DataFrame:
    """The weighted mean of each ring's mean channels; weights are scaled to sum 1 over the rings that a node has."""
    if len(weights) == 2 and all(w > 0 for w in weights) and (got := _packed(state, g, label)):
        w, v = map(float, weights)
        return _with_near(*got, ("out", "in"), False, "mean", lambda x, m, some: np.where(some[:, None], (x * w + m * v) / (w + v), x))
    table = F.array(*(F.lit(float(w)) for w in weights))
    ring = _rings(g, state, len(weights) - 1, label).join(_exploded(state), F.col("b") == F.col(ID)).groupBy("a", "d", "i").agg(F.avg("x").alias("x"))
    w = F.element_at(table, F.col("d") + 1)
    return _collected(ring.groupBy("a", "i").agg((F.sum(F.col("x") * w) / F.sum(w)).alias("x")), "a")


def pool(state: DataFrame, g: Graph, size: int, how: str = "max", label: str | None = None) -> DataFrame:
    """Groups of up to `size` nodes grown breadth-first from the least free id, each one node of that id. It is sequential by
    its nature: one task has the whole graph."""
    e = settled(steps(g.labelled(label), "both").groupBy("a").agg(F.sort_array(F.collect_set("b")).alias("near")))
    table = state.join(e, F.col(ID) == F.col("a"), "left").select(ID, "channels", "near")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near = {k: [] if v is None else list(v) for k, v in zip(pdf[ID], pdf["near"])}
        value, free, out = dict(zip(pdf[ID], pdf["channels"])), set(pdf[ID]), []
        for s in sorted(free):
            if s not in free:
                continue
            group, queue = [], [s]
            while queue and len(group) < size:
                v = queue.pop(0)
                if v in free:
                    free.discard(v)
                    group.append(v)
                    queue += [w for w in near[v] if w in free]
            x = np.array([value[v] for v in group])
            out.append((s, (x.max(0) if how == "max" else x.mean(0)).tolist()))
        return pd.DataFrame(out, columns=[ID, "channels"])

    return table.groupBy().applyInPandas(run, STATE)


def dense(state: DataFrame, w: list[list[float]], b: list[float], gating: str | None = None) -> DataFrame:
    m, c = np.array(w), np.array(b)
    return _rows(state, lambda x: gate(x @ m.T + c, gating))


def softmax(state: DataFrame) -> DataFrame:
    """(_doc_id, channels: class probabilities, _score: the greatest)."""

    def f(x):
        e = np.exp(x - x.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    return _rows(state, f).withColumn(SCORE, F.array_max("channels"))


def dropout(state: DataFrame, p: float) -> DataFrame:
    """At inference: scaled by 1 - p."""
    return state.select(ID, F.transform("channels", lambda x: x * (1 - p)).alias("channels"))


def batch_norm(state: DataFrame, eps: float = 1e-5) -> DataFrame:
    """Each channel to mean 0 and variance 1 over the nodes; fewer than two stay as they are."""
    stats = {r.i: (r.m, r.v, r.n) for r in _exploded(state).groupBy("i").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.count("*").alias("n")).collect()}
    if not stats or min(s[2] for s in stats.values()) < 2:
        return state
    m, v = (np.array([stats[i][k] for i in sorted(stats)]) for k in (0, 1))
    return _rows(state, lambda x: (x - m) / np.sqrt(v + eps))


def flatten(state: DataFrame) -> DataFrame:
    """All channels in order of the ids, on the least id."""
    return state.agg(F.min(ID).alias(ID), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(ID, "channels"))), lambda x: x["channels"])).alias("channels"))


def global_pool(state: DataFrame, how: str = "avg") -> DataFrame:
    each = _exploded(state).groupBy("i").agg(F.avg("x").alias("avg"), F.max("x").alias("max"), F.min(ID).alias("id"))
    ordered = each.agg(F.min("id").alias(ID), F.sort_array(F.collect_list(F.struct("i", "avg", "max"))).alias("c"))
    avg, most = F.transform("c", lambda e: e["avg"]), F.transform("c", lambda e: e["max"])
    return ordered.select(ID, {"avg": avg, "max": most, "avg_max": F.concat(avg, most)}[how].alias("channels"))


def attention(state: DataFrame, mode: str = "content", seed: int = 0) -> DataFrame:
    """Self-attention of all nodes with each other: one task has all of them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ID)
        x = np.array(pdf["channels"].tolist(), np.float64)
        q = k = x
        if mode == "random_qk":
            rng = np.random.default_rng(seed)
            q, k = (x @ rng.normal(size=(x.shape[1],) * 2) / math.sqrt(x.shape[1]) for _ in range(2))
        s = q @ k.T / math.sqrt(x.shape[1])
        e = np.exp(s - s.max(1, keepdims=True))
        return pd.DataFrame({ID: pdf[ID].to_numpy(), "channels": list((e / e.sum(1, keepdims=True)) @ x)})

    return state.groupBy().applyInPandas(run, STATE)


# --- kernels, grids, training ------------------------------------------------------------------------------------------------


def kernels(kind: str, n: int, size: int, channels: int = 1, seed: int = 0) -> np.ndarray:
    """n kernels of channels x size x size: kaiming, orthogonal or gabor."""
    rng, d = np.random.default_rng(seed), channels * size * size
    if kind == "kaiming":
        k = rng.normal(size=(n, d)) * math.sqrt(2 / d)
    elif kind == "orthogonal":
        k = np.concatenate([np.linalg.qr(rng.normal(size=(d, d)))[0] for _ in range(-(-n // d))])[:n]
    elif kind == "gabor":
        at = np.arange(size) - (size - 1) / 2
        y, x = np.meshgrid(at, at, indexing="ij")
        angles = np.arange(n) * np.pi / n
        waves = [np.exp(-(x**2 + y**2) / size) * np.cos(2 * np.pi * (x * np.cos(a) + y * np.sin(a)) / max(2, size - 1)) for a in angles]
        k = np.repeat(np.array(waves).reshape(n, 1, -1), channels, 1).reshape(n, d) / channels
    else:
        raise ValueError(f"no such kernels: {kind}")
    return k.reshape(n, channels, size, size)


def grid_conv(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """batch x channels x h x w with n kernels, the border padded with zeros: batch x n x h x w."""
    p = k.shape[-1] // 2
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (0, 0), (p, p), (p, p))), k.shape[-2:], (2, 3))[:, :, : x.shape[2], : x.shape[3]]
    return np.einsum("bchwij,ncij->bnhw", windows, k)


def grid_pool(x: np.ndarray, size: int, how: str = "max") -> np.ndarray:
    h, w = x.shape[2] // size, x.shape[3] // size
    parts = x[:, :, : h * size, : w * size].reshape(*x.shape[:2], h, size, w, size)
    return parts.max((3, 5)) if how == "max" else parts.mean((3, 5))


@dataclass
class Model:
    """A trained model: convolution and pooling over a square grid of each row's vector, then one linear head."""

    classes: list
    side: int
    layers: list[dict] = field(default_factory=list)
    weights: list = field(default_factory=list)
    mean: list = field(default_factory=list)

    def features(self, v: np.ndarray) -> np.ndarray:
        x = v.reshape(len(v), -1, self.side, self.side)
        for layer in self.layers:
            if layer["kind"] == "conv":
                x = gate(grid_conv(x, np.array(layer["kernels"])), layer.get("gating", "relu"))
            else:
                x = grid_pool(x, layer["size"], layer.get("how", "max"))
        return np.concatenate([x.reshape(len(x), -1), np.ones((len(x), 1))], 1)

    def probabilities(self, v: np.ndarray) -> np.ndarray:
        s = self.features(v) @ np.array(self.weights) * 4
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @staticmethod
    def from_json(s: str) -> Model:
        return Model(**json.loads(s))


def ridge(xx: np.ndarray, xy: np.ndarray, lam: float) -> np.ndarray:
    return np.linalg.solve(xx + lam * np.eye(len(xx)), xy)


def elastic_net(xx: np.ndarray, xy: np.ndarray, lam: float, l1_ratio: float, rounds: int = 200, tol: float = 1e-4) -> np.ndarray:
    """Proximal gradient steps on the normal equations."""
    step = 1 / (np.linalg.eigvalsh(xx)[-1] + lam * (1 - l1_ratio) + 1e-12)
    w = np.zeros_like(xy)
    for _ in range(rounds):
        new = w - step * (xx @ w - xy + lam * (1 - l1_ratio) * w)
        new = np.sign(new) * np.maximum(np.abs(new) - step * lam * l1_ratio, 0)
        if np.abs(new - w).max() < tol:
            return new
        w = new
    return w


def prune(w: np.ndarray, ratio: float) -> np.ndarray:
    """The smallest share of weights set to 0."""
    return np.where(np.abs(w) < np.quantile(np.abs(w), ratio), 0.0, w) if ratio else w


def deep_learn(rows: DataFrame, label: str, embedding: str, layers: list[dict] | None = None, lam: float = 1.0, l1_ratio: float = 0.0, prune_ratio: float = 0.0) -> Model:
    """A model of `label` from `embedding`, whose length is a square number times the input channels (1).

    Each batch adds its products of features and one-hot labels; the tasks' sums are added by Spark by position. Rows with a
    null in either column are left out."""
    some = rows.where(F.col(label).isNotNull() & F.col(embedding).isNotNull()).select(F.col(label).alias("y"), F.col(embedding).cast("array<double>").alias("v"))
    classes = sorted(r.y for r in some.select("y").distinct().collect())
    d = len(some.first().v)
    model = Model(classes, int(math.isqrt(d)), [])
    for i, layer in enumerate(layers or []):
        layer = dict(layer)
        if layer["kind"] == "conv":
            c = 1 if not any(x["kind"] == "conv" for x in model.layers) else len([x for x in model.layers if x["kind"] == "conv"][-1]["kernels"])
            layer["kernels"] = kernels(layer.pop("init", "kaiming"), layer.pop("n", 4), layer.pop("size", 3), c, i).tolist()
        model.layers.append(layer)
    n_features = model.features(np.zeros((1, d))).shape[1]

    def sums(batches):
        xx, xy = np.zeros((n_features,) * 2), np.zeros((n_features, len(classes)))
        for batch in batches:
            if len(batch):
                f = model.features(np.array(batch["v"].to_pylist()))
                y = np.zeros((len(batch), len(classes)))
                y[np.arange(len(batch)), [classes.index(x) for x in batch["y"].to_pylist()]] = 1
                xx += f.T @ f
                xy += f.T @ y
        flat = np.concatenate([xx.ravel(), xy.ravel()])
        at = np.flatnonzero(flat)
        yield pa.record_batch([pa.array(at), pa.array(flat[at])], ["i", "x"])

    got = some.mapInArrow(sums, "i bigint, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    flat = np.zeros(n_features * (n_features + len(classes)))
    flat[got.i.to_numpy()] = got.x.to_numpy()
    xx, xy = flat[: n_features**2].reshape(n_features, -1), flat[n_features**2 :].reshape(n_features, -1)
    model.weights = prune(elastic_net(xx, xy, lam, l1_ratio) if l1_ratio else ridge(xx, xy, lam), prune_ratio).tolist()
    return model


def deep_predict(rows: DataFrame, doc_id: str, embedding: str, model: Model) -> DataFrame:
    """(_doc_id, label, _score, probabilities) for every row with a vector."""

    def run(batches):
        for batch in batches:
            if len(batch):
                p = model.probabilities(np.array(batch["v"].to_pylist()))
                k = p.argmax(1)
                yield pa.record_batch([batch[ID], pa.array([str(model.classes[i]) for i in k]), pa.array(p[np.arange(len(p)), k]), pa.array(list(p), pa.list_(pa.float64()))], [ID, "label", SCORE, "probabilities"])

    some = rows.where(F.col(embedding).isNotNull()).select(F.col(doc_id).cast("bigint").alias(ID), F.col(embedding).cast("array<double>").alias("v"))
    return some.mapInArrow(run, f"{ID} bigint, label string, {SCORE} double, probabilities array<double>")


def estimate_conv_weights(docs: DataFrame, doc_id: str, column: str, g: Graph, most: int = 2, label: str | None = None) -> list[float]:
    """The mean cosine of nodes at each distance 0..most, scaled to sum 1."""
    from weft.operators.vector import cosine

    state = embed(docs, doc_id, column)
    a, b = state.select(F.col(ID).alias("a"), F.col("channels").alias("x")), state.select(F.col(ID).alias("b"), F.col("channels").alias("y"))
    got = {r.d: max(r.c or 0.0, 0.0) for r in _rings(g, state, most, label).join(a, "a").join(b, "b").groupBy("d").agg(F.avg(cosine(F.col("x"), F.col("y"))).alias("c")).collect()}
    w = [got.get(d, 0.0) for d in range(most + 1)]
    return [x / (sum(w) or 1.0) for x in w]


