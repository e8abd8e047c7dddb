"""Vector retrieval: cosine top-k, thresholds, exclusion, joins, inverted-file cells, and calibrated probabilities."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators import fusion, graph
from weft.operators.signals import ID, SCORE, difference, signal, top_k


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null for vectors of length 0 and for nulls."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def similarities(docs: DataFrame, doc_id: str, column: str, query: list[float]) -> DataFrame:
    """Every vector's cosine with the query as a signal: Arrow batches and one matrix product each, as the query is constant.

    Nulls, vectors of another length and those of length 0 are left out."""
    q = np.array(query, np.float64)
    q = q / (np.linalg.norm(q) or 1.0)

    def run(batches):
        for batch in batches:
            v, ids = batch["v"], batch[ID]
            n = np.diff(v.offsets.to_numpy())
            keep = np.flatnonzero((n == len(q)) & ~v.is_null().to_numpy(zero_copy_only=False))
            x = v.take(pa.array(keep)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(keep), len(q))
            size = np.sqrt((x * x).sum(1))
            ok = np.isfinite(size) & (size > 0)
            yield pa.record_batch([ids.take(pa.array(keep[ok])), pa.array(x[ok] @ q / size[ok])], [ID, SCORE])

    some = docs.select(F.col(doc_id).cast("bigint").alias(ID), F.col(column).cast("array<double>").alias("v")).where(f"{ID} is not null")
    return some.mapInArrow(run, f"{ID} bigint, {SCORE} double")


def knn(docs: DataFrame, doc_id: str, column: str, query: list[float], k: int) -> DataFrame:
    """The k vectors of greatest cosine: each task keeps its k best, then they are merged."""
    return top_k(similarities(docs, doc_id, column, query), k)


def within(docs: DataFrame, doc_id: str, column: str, query: list[float], least: float) -> DataFrame:
    return similarities(docs, doc_id, column, query).where(F.col(SCORE) >= least)


def probability(s: DataFrame) -> DataFrame:
    """(1 + cosine) / 2."""
    return s.select(ID, ((1 + F.col(SCORE)) / 2).alias(SCORE))


def exclude(docs: DataFrame, doc_id: str, column: str, positive: list[float], negative: list[float], k: int, least: float) -> DataFrame:
    """The k nearest to one vector without those whose cosine with another is at least `least`."""
    return difference(knn(docs, doc_id, column, positive, k), within(docs, doc_id, column, negative, least))


def background(docs: DataFrame, doc_id: str, column: str, query: list[float]) -> tuple[float, float]:
    """Mean and deviation of all cosines with a query."""
    r = similarities(docs, doc_id, column, query).agg(F.avg(SCORE).alias("m"), F.stddev_samp(SCORE).alias("s")).first()
    return (r.m or 0.0, r.s or 1.0)


def calibrated(docs: DataFrame, doc_id: str, column: str, query: list[float], k: int, base_rate: float = 0.5, weights: str = "distance_gap", bandwidth_scale: float = 1.0) -> DataFrame:
    """KNN as probabilities: sigmoid(log(f_R / f_G) + logit(base rate)), f_R a Gaussian kernel density over the k best scores
    (weighted uniformly or by their gap to the k-th), f_G the normal density of all scores. The k best are bounded by k."""
    m, s = background(docs, doc_id, column, query)
    near = knn(docs, doc_id, column, query, k)
    got = sorted((r[SCORE] for r in near.collect()), reverse=True)
    if not got:
        return near
    w = np.array([1.0] * len(got) if weights == "uniform" else [x - got[-1] + 1e-6 for x in got])
    w /= w.sum()
    h = max(1e-3, 1.06 * float(np.std(got)) * len(got) ** -0.2) * bandwidth_scale
    density = sum((F.exp(-0.5 * ((F.col(SCORE) - x) / h) ** 2) * (float(v) / (h * math.sqrt(2 * math.pi))) for x, v in zip(got, w)), F.lit(0.0))
    ground = F.exp(-0.5 * ((F.col(SCORE) - m) / s) ** 2) / (s * math.sqrt(2 * math.pi))
    odds = F.ln(density + 1e-300) - F.ln(ground + 1e-300) + math.log(base_rate / (1 - base_rate))
    return near.select(ID, F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), fusion.sigmoid(odds))).alias(SCORE))


#: Elements of the vectors of a block, and pairs of which cosines are held at once.
BLOCK, HELD = 1 << 21, 1 << 22


def _matrix(v: pa.ListArray | pa.ChunkedArray, like: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a vector (of `like` elements) without nulls and of a finite length above 0, and these vectors."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    n = np.diff(v.offsets.to_numpy())
    flat = v.flatten()
    if flat.null_count:
        holes = np.r_[0, np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))]
        ends = np.r_[0, np.cumsum(np.where(v.is_null().to_numpy(zero_copy_only=False), 0, n))]
        n = np.where(holes[ends[1:]] > holes[ends[:-1]], -1, n)
    keep = np.flatnonzero((n == like) & ~v.is_null().to_numpy(zero_copy_only=False))
    x = v.take(pa.array(keep)).flatten().to_numpy(zero_copy_only=False).reshape(len(keep), like)
    size = np.linalg.norm(x.astype(np.float64), axis=1)
    ok = np.isfinite(size) & (size > 0)
    return keep[ok], x[ok]


def _near(x: np.ndarray, y: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of x, rows of y, cosines) of at least `least`, piece by piece. Products in single precision find the pairs, less
    what its rounding can be; their cosines are of doubles."""
    sizes = [np.linalg.norm(m.astype(np.float64), axis=1) for m in (x, y)]
    u, w = ((m / s[:, None]).astype(np.float32) for m, s in zip((x, y), sizes))
    low = np.float32(least - (x.shape[1] + 16) * 2.0**-22)
    wide = min(len(y), 8192)
    high = max(1, HELD // max(1, wide))
    for i in range(0, len(x), high):
        for j in range(0, len(y), wide):
            p, q = np.nonzero(u[i : i + high] @ w[j : j + wide].T >= low)
            each = max(1, HELD // x.shape[1])
            for k in range(0, len(p), each):
                a, b = p[k : k + each] + i, q[k : k + each] + j
                s = np.einsum("ij,ij->i", x[a].astype(np.float64), y[b].astype(np.float64)) / (sizes[0][a] * sizes[1][b])
                ok = s >= least
                yield a[ok], b[ok], s[ok]


def join(left: DataFrame, right: DataFrame, left_on: tuple[str, str], right_on: tuple[str, str], least: float, equal: list[tuple[str, str]] | None = None) -> DataFrame:
    """(left_id, right_id, _score) of pairs of rows whose vectors have at least that cosine; `equal` pairs of columns must be
    equal. (id, vector) columns of both sides are given. Vectors with nulls, of length 0 or not finite have no pairs, nor do
    those of different numbers of elements.

    Rows of equal keys meet in a grid of blocks: every pair of blocks is a group of its own, multiplied piece by piece, every
    pair of rows once and no side broadcast. A block has BLOCK elements on average whatever the size of the table; what is
    replicated is a vector to the blocks that the other side has of its keys."""
    (li, lv), (ri, rv) = left_on, right_on
    equal = equal or []
    spark, keys = left.sparkSession, [*(f"_k{i}" for i in range(len(equal))), "_n"]

    def rows(df: DataFrame, i: str, v: str, on: list[str]) -> DataFrame:
        t = df.schema[v].dataType
        own = F.col(v) if t.elementType.typeName() in ("float", "double") else F.col(v).cast("array<double>")
        return df.select((F.col(i) if equal else F.col(i).cast("bigint")).alias("id"), own.alias("v"), *(F.col(c).alias(f"_k{k}") for k, c in enumerate(on)), F.size(v).alias("_n")).dropna(subset=["id", "v", *keys[:-1]])

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(F.count("*") * F.col("_n") / F.lit(BLOCK)).cast("int").alias(name))

    a, b = rows(left, li, lv, [x for x, _ in equal]), rows(right, ri, rv, [y for _, y in equal])
    grid = graph.settled(blocks(a, "_a").join(blocks(b, "_b"), keys).where("_n > 0"))
    grid = F.broadcast(grid) if grid.count() <= 100_000 else grid
    here, every = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    both = [df.join(grid, keys).withColumn("i", here("_a") if not s else every("_a")).withColumn("j", every("_b") if not s else here("_b")).select(*keys, "i", "j", "id", "v", F.lit(s).alias("side")) for s, df in enumerate((a, b))]
    cell = [*keys, "i", "j"]
    names = ["left_id", "right_id", SCORE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).select(["_n", "id", "v", "side"])
        n = table["_n"][0].as_py()
        parts = []
        for s in (0, 1):
            own = table.filter(pc.equal(table["side"], s))
            keep, x = _matrix(own["v"], n)
            parts.append((own["id"].combine_chunks().take(pa.array(keep)), x))
        del table, own
        (p, x), (q, y) = parts
        for i, j, s in _near(x, y, least):
            if len(s):
                yield pa.RecordBatch.from_arrays([p.take(pa.array(i)), q.take(pa.array(j)), pa.array(s)], names)

    both = both[0].unionByName(both[1])
    kind = both.schema["id"].dataType.simpleString()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # given, so that small partitions of much work aren't merged
    return both.repartition(n, *cell).groupBy(*cell).applyInArrow(run, f"left_id {kind}, right_id {kind}, {SCORE} double")


class IVF:
    """An inverted file: vectors in cells of k-means centroids; a query looks at the nearest cells alone. Centroids are fitted
    by rounds of one aggregate each."""

    def __init__(self, docs: DataFrame, doc_id: str, column: str, cells: int = 16, rounds: int = 8, seed: int = 0):
        self.rows = docs.select(F.col(doc_id).cast("bigint").alias(ID), F.col(column).cast("array<double>").alias("v")).where("v is not null")
        first = self.rows.orderBy(F.xxhash64(F.col(ID), F.lit(seed))).limit(cells).collect()
        self.centroids = np.array([r.v for r in first], np.float64)
        for _ in range(rounds):
            got = self.assigned().select("cell", F.posexplode("v").alias("i", "x")).groupBy("cell", "i").agg(F.avg("x").alias("x")).collect()
            for r in got:
                self.centroids[r.cell, r.i] = r.x

    def assigned(self) -> DataFrame:
        c = self.centroids / np.maximum(np.linalg.norm(self.centroids, axis=1, keepdims=True), 1e-300)

        def run(batches):
            for batch in batches:
                x = np.array(batch["v"].to_pylist(), np.float64).reshape(len(batch), -1)
                cell = (x @ c.T).argmax(1) if len(x) else np.empty(0, np.int64)
                yield pa.record_batch([batch[ID], batch["v"], pa.array(cell.astype(np.int32))], [ID, "v", "cell"])

        return self.rows.mapInArrow(run, f"{ID} bigint, v array<double>, cell int")

    def search(self, query: list[float], k: int, probes: int = 4) -> DataFrame:
        q = np.array(query, np.float64)
        c = self.centroids / np.maximum(np.linalg.norm(self.centroids, axis=1, keepdims=True), 1e-300)
        near = np.argsort(-(c @ q))[:probes].tolist()
        return knn(self.assigned().where(F.col("cell").isin(near)), ID, "v", query, k)


def hybrid(text: DataFrame, docs: DataFrame, doc_id: str, column: str, query: list[float], least: float) -> DataFrame:
    """Documents of a text signal whose vectors are within the threshold, scores summed."""
    v = within(docs, doc_id, column, query, least).withColumnRenamed(SCORE, "_v")
    return signal(text.join(v, ID), ID, F.col(SCORE) + F.col("_v"))
