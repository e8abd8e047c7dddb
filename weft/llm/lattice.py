"""Near-duplicate embeddings by lattice hashing.

Unit vectors are projected to eight dimensions, several times at random, and each projection is decoded to the nearest point of
the lattice E8: its cell. Close vectors share a cell or lie in neighbouring ones, so every vector is kept in its own cell and
looked up in that and in the next nearest cells around it. Pairs that meet in some table are verified by their cosine.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import Links, components, written

#: Least cosine of a pair, tables, neighbouring cells looked up in each, and the lattice's scale in the projected space.
LEAST, TABLES, PROBES, SCALE = 0.95, 6, 4, 0.11 * 8**0.5
SEED = 20


@cache
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [v for v in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)


def _d8(y: np.ndarray) -> np.ndarray:
    """The nearest points of D8: integers of even sum."""
    p = np.rint(y)
    off = y - p
    odd = np.flatnonzero(p.sum(1) % 2)
    at = np.abs(off[odd]).argmax(1)
    p[odd, at] += np.where(off[odd, at] >= 0, 1, -1)
    return p


def nearest(y: np.ndarray) -> np.ndarray:
    """The nearest point of E8, the union of D8 and D8 moved by a half, for each row; of two the one in D8."""
    a, b = _d8(y), _d8(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1))[:, None], a, b)


@cache
def projections(dim: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """(tables x 8 x dim, tables x 8): rows of each table are orthogonal and as long as keeps lengths on average, so that distances
    between cells mean the same for vectors of any length."""
    rng = np.random.default_rng([SEED, dim])
    r = np.stack([np.linalg.qr(rng.normal(size=(max(dim, 8), 8)))[0].T[:, :dim] for _ in range(tables)]) * np.sqrt(max(dim, 8) / 8)
    return r, rng.uniform(0, 1, (tables, 8))


def mixed(x: np.ndarray, start: int) -> np.ndarray:
    """A 64-bit hash of each row of integers."""
    h = np.full(len(x), start, np.uint64)
    for c in range(x.shape[1]):
        h = (h ^ x[:, c].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def cells(x: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> np.ndarray:
    """Hashes of cells, rows x tables x (1 + probes): each unit vector's own cell and the next nearest ones."""
    r, shift = projections(x.shape[1], tables)
    own, v = [], neighbours()
    for t in range(tables):
        y = x @ r[t].T / scale + shift[t]
        p = nearest(y)
        near = np.argpartition((p - y) @ v.T, probes - 1, 1)[:, :probes] if probes else np.empty((len(x), 0), int)
        points = np.concatenate([p[:, None], p[:, None] + v[near]], 1)
        own.append(mixed((2 * points).reshape(-1, 8), x.shape[1] * 1000 + t).reshape(len(x), 1 + probes))
    return np.stack(own, 1)


def _unit(embedding: pa.ListArray) -> tuple[np.ndarray, pa.ListArray]:
    """(rows, vectors): the vectors of those rows at length 1. Left out are null ones, ones with null or non-finite numbers, and
    those of length 0."""
    rows = np.flatnonzero(embedding.is_valid().to_numpy(zero_copy_only=False))
    some = embedding.take(pa.array(rows))
    n = np.diff(some.offsets.to_numpy())
    x = some.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    doc = np.repeat(np.arange(len(rows)), n)
    # by the largest number first, so that squares don't overflow
    most = np.zeros(len(rows))
    with np.errstate(invalid="ignore"):
        np.maximum.at(most, doc, np.abs(x))
    fit = np.isfinite(most) & (most > 0)
    x = x[fit[doc]] / most[doc[fit[doc]]]
    rows, n = rows[fit], n[fit]
    doc = np.repeat(np.arange(len(rows)), n)
    x /= np.sqrt(np.bincount(doc, x * x, len(rows)))[doc]
    return rows, pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(x.astype(np.float32)))


def near_links(vectors: DataFrame, least: float = LEAST, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> DataFrame:
    """(vec_id, class_id, links) for every vec_id: how many other vectors have a cosine of at least `least` with its own, and the
    least vec_id that such links connect it with, over others maybe: itself, if it has none.

    Every row is a query, and no number of partners or candidates is capped; of links between different vectors, those between
    some in neighbouring cells of no table are missed (recall is above 0.9 at any length of vectors), none is told falsely.
    Cosines are those of vectors in single precision. Null vectors, ones with nulls or NaNs, and zero vectors have no link;
    vectors of different lengths are never linked; rows of null vec_id are left out; rows that repeat a vec_id with the same
    vector count once; a vec_id with several vectors counts as one for each of them, all of one class, whose links are added up.
    Equal vectors are hashed once. An empty table gives an empty one; other columns aren't read. What is sent on of the links are
    their numbers and the edges of trees that connect what they connect.
    """

    def normal(batches):
        for batch in batches:
            rows, unit = _unit(batch["embedding"])
            yield pa.record_batch([batch["vec_id"].take(pa.array(rows)), unit], ["vec_id", "unit"])

    def hashed(batches):
        for batch in batches:
            ids, unit = batch["vec_id"].to_numpy(), batch["unit"]
            dims = np.diff(unit.offsets.to_numpy())
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                for at in range(0, len(rows), 2000):
                    some = rows[at : at + 2000]
                    x = unit.take(pa.array(some)).flatten().to_numpy().reshape(len(some), dim).astype(np.float64)
                    c = cells(x, tables, probes, scale)
                    own = np.zeros(c.shape, bool)
                    own[:, :, 0] = True
                    yield pa.record_batch([pa.array(c.ravel()), pa.array(np.repeat(ids[some], c[0].size)), pa.array(own.ravel())], ["cell", "id", "own"])

    def verify(batches):
        for batch in batches:
            a, b = (batch[c].flatten().to_numpy().astype(np.float64) for c in ("unit_a", "unit_b"))
            n = np.diff(batch["unit_a"].offsets.to_numpy())
            at = np.repeat(np.arange(len(n)), n)
            # once more at length 1: single precision moves it
            cosine = np.bincount(at, a * b, len(n)) / np.sqrt(np.bincount(at, a * a, len(n)) * np.bincount(at, b * b, len(n)))
            linked = batch.filter(pa.array(cosine >= least - 1e-9))
            a, b = (linked[c].to_numpy() for c in "ab")
            ids, first, at = np.unique(np.r_[a, b], return_index=True, return_inverse=True)
            weights, lowest = (np.r_[linked[f"{c}_a"].to_numpy(), linked[f"{c}_b"].to_numpy()][first] for c in ("weight", "lowest"))
            links = Links(weights)
            links.tell(at[: len(a)], at[len(a) :])
            yield pa.record_batch([ids, links.n, lowest, lowest[links.label]], names=["id", "links", "a", "b"])

    known = vectors.where("vec_id is not null").select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    units = known.mapInArrow(normal, "vec_id bigint, unit array<float>")
    # equal vectors are one
    items = written(units.distinct().withColumn("id", F.xxhash64("unit")), "items")
    groups = written(items.groupBy("unit", "id").agg(F.count("vec_id").alias("weight"), F.min("vec_id").alias("lowest")).withColumn("id", F.xxhash64("id", "lowest")), "vectors")
    members = items.join(groups.select("unit", F.col("id").alias("group"), "weight", "lowest"), "unit").select("vec_id", F.col("group").alias("id"), "weight", "lowest")
    rows = written(groups.select(F.col("id").alias("vec_id"), "unit").mapInArrow(hashed, "cell bigint, id bigint, own boolean"), "cells")
    kept, asked = rows.where("own").select("cell", F.col("id").alias("x")), rows.select("cell", F.col("id").alias("y"))
    met = kept.join(asked, "cell").where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    of = lambda c: groups.select(F.col("id").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("unit", "weight", "lowest")))
    both = met.join(of("a"), "a").join(of("b"), "b").where(F.size("unit_a") == F.size("unit_b"))
    near = written(both.mapInArrow(verify, "id bigint, links bigint, a bigint, b bigint"), "near")
    members = written(members, "members")
    links = near.groupBy("id").agg(F.sum("links").alias("links"))
    links = members.join(links, "id", "left").groupBy("vec_id").agg(F.sum(F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    labels = components(near.select("a", "b").unionByName(members.select(F.col("lowest").alias("a"), F.col("vec_id").alias("b")))).select(F.col("a").alias("vec_id"), "label")
    every = known.select("vec_id").distinct().join(links, "vec_id", "left").join(labels, "vec_id", "left")
    return every.select("vec_id", F.coalesce("label", "vec_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
