"""Exact n-gram Jaccard self-join in the metric space of n-gram sets.

Distance is 1 - Jaccard, a metric. Documents become sets of hashed word n-grams. Unrelated documents are all at distance 1 from
each other, so pivots must be near what they part: they are documents themselves, found by shared n-grams. In a global order
that puts rare n-grams first, two documents within the threshold share n-grams among their first ones (the prefix);
a common one makes all documents that have it members of a region, a rare one just counts for the pairs that share it. Members
that can share enough with no other don't count, and texts are sent to regions only for those that can. Within a region, pivots create Voronoi cells; a document is replicated to every other cell
that the triangle inequality doesn't rule out; cells are split again until they are small or can't be split, and then joined by
counting shared n-grams. Any pair within the threshold meets in some cell, and every link told has been verified on whole sets.
Links are counted where they are found and sent on as numbers and as edges of spanning trees, never as pairs.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import Links, buckets, components, input_bytes, pack, rows, texts, unpack, written

#: Words of an n-gram; least Jaccard of a pair.
N, LEAST = 3, 0.6
#: n-grams that a pair shares in its prefixes at least, if its sets are so large (larger ones share more); n-grams that more than SMALL documents have
#: there make regions, others count for pairs.
SHARED, SMALL = 16, 8
#: n-grams whose frequency the order of n-grams knows; bits of the table of others that occur OFTEN at least, as a logarithm, and how many it has for each
#: while it is smaller.
GRAMS, TABLE, SPARSE, OFTEN = 1 << 20, 28, 16, 3
#: Documents joined at once in a cell; documents of a region that one task joins; n-grams of theirs, eight bytes of text counting as one at least.
LEAF, REGION, CELL = 512, 20_000, 1 << 21
#: n-grams of a cell that are looked at at once.
PART = 1 << 18
#: n-grams that a task holds before it sends them on.
HELD = 500_000
#: n-grams that two pivots share in their prefixes for their regions to be one.
STRONG = 8
#: Times that regions lose members who meet too few; documents of regions that are left to pairs.
ROUNDS, MIDDLE = 3, 64
#: Most ids of candidates that are sent to all tasks.
BROADCAST = 1_000_000
BLOCK = 1 << 18
BODIES = pa.schema([("bucket", pa.int32()), ("body", pa.binary())])
MET = ["p", "x", "least", "n", "kind"]
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of BASE and of its inverse modulo 2**64, as many as were asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)]) for b in (BASE, inverse))
        return self.up[:n], self.down[:n]


_powers = _Powers()


class Block:
    """n-grams of some texts as hashes of their bytes: words are parted by white space, in lower case."""

    def __init__(self, batch: list[str | None], n: int = N):
        clean = [" ".join((x or "").lower().split()).encode("utf-8", "surrogatepass") for x in batch]
        words = np.fromiter((x.count(b" ") + 1 if x else 0 for x in clean), np.int64, len(clean))
        raw = np.frombuffer(b" ".join(x for x in clean if x) + b" ", np.uint8)
        ends = np.flatnonzero(raw == 32) if words.any() else np.empty(0, np.int64)
        starts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
        up, self.down = _powers.upto(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=self.sums[1:])
        self.starts, self.ends, self.words = starts, ends, words
        self.word_doc = np.repeat(np.arange(len(batch)), words)
        first = np.cumsum(words) - words
        grams = np.where(words >= n, words - n + 1, np.minimum(words, 1))
        #: of each n-gram: its document, its first and its last word
        self.doc = np.repeat(np.arange(len(batch)), grams)
        at = np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams, grams)
        self.first = np.repeat(first, grams) + at
        self.last = np.minimum(self.first + n - 1, np.repeat(first + words - 1, grams))
        self.grams = grams

    def _hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64))

    def gram_hashes(self) -> np.ndarray:
        return self._hash(self.starts[self.first], self.ends[self.last])

    def sets(self, keys: np.ndarray) -> list[np.ndarray]:
        """Of each document the distinct keys, sorted; keys has one for each n-gram."""
        ends = np.cumsum(self.grams).tolist()
        return [np.unique(keys[a:b]) for a, b in zip([0, *ends], ends)]


def _blocks(batch: pa.RecordBatch):
    """(rows, texts) of about BLOCK characters each."""
    own, held, n = [], [], 0
    for i, x in enumerate(batch["text"]):
        x = x.as_py()
        if own and n + len(x or "") > BLOCK:
            yield own, held
            own, held, n = [], [], 0
        own.append(i)
        held.append(x)
        n += len(x or "")
    if own:
        yield own, held


def _planes(x: np.ndarray) -> bytes:
    """The bytes of numbers plane by plane: high ones are mostly zeros, which compress to nothing."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _numbers(raw: memoryview, kind: type) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _cut(key: np.ndarray, bits: int, n_buckets: int) -> np.ndarray:
    """Where the buckets begin and end among sorted keys of so many bits; a bucket is a range of keys."""
    edges = [(b << bits) // n_buckets for b in range(n_buckets)]
    return np.r_[np.searchsorted(key, np.array(edges, np.uint64)), len(key)]


def _gram_counts(bits: int, n_buckets: int, n: int):
    """(bucket, body): how often n-grams occur in the texts of a task, of their hashes the first bits."""

    def run(batches):
        held, size = [], 0

        def flush():
            key, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            cut, out = _cut(key, bits, n_buckets), []
            for b in range(n_buckets):
                k = key[cut[b] : cut[b + 1]]
                if len(k):
                    out.append((b, pack(_planes(np.diff(k, prepend=np.uint64(0))), _planes(n[cut[b] : cut[b + 1]].astype(np.uint32)))))
            return rows(out, BODIES)

        for batch in batches:
            for _, some in _blocks(batch):
                held.append(Block(some, n).gram_hashes() >> np.uint64(64 - bits))
                size += len(held[-1])
                if size > HELD:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    return run


def _gram_sums(batches):
    """(gram, c): the logarithms of the frequencies of the n-grams of a partition that are at least four."""
    keys, counts = [np.empty(0, np.uint64)], [np.empty(0, np.uint32)]
    for batch in batches:
        for body in batch["body"]:
            k, n = unpack(body.as_buffer())
            keys.append(np.cumsum(_numbers(k, np.uint64), dtype=np.uint64))
            counts.append(_numbers(n, np.uint32))
    key, n = np.concatenate(keys), np.concatenate(counts)
    del keys, counts
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order].astype(np.int64)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    n = np.add.reduceat(n, starts) if len(starts) else n
    often = n >= 4
    key, c = key[starts][often], np.log2(n[often]).astype(np.int8)
    for at in range(0, len(key), 100_000):
        yield pa.record_batch([pa.array(key[at : at + 100_000].view(np.int64)), pa.array(c[at : at + 100_000])], ["gram", "c"])


class Order:
    """An order of n-grams that has the rare ones first: ranks by their hashes. Any order gives the same pairs."""

    def __init__(self, bits: int, grams: np.ndarray, classes: np.ndarray, wide: int, table: np.ndarray):
        self.bits, self.grams, self.classes, self.wide, self.table = bits, grams, classes, wide, table

    def ranks(self, h: np.ndarray) -> np.ndarray:
        """The logarithm of the frequency where it is known, else 1 for frequent n-grams and those that share their bit, else 0."""
        rank = np.zeros(len(h), np.uint8)
        if len(self.table):
            cell = h >> np.uint64(64 - self.wide)
            rank = self.table[cell >> np.uint64(3)] >> (7 - (cell & np.uint64(7)).astype(np.uint8)) & 1
        if len(self.grams):
            short = h >> np.uint64(64 - self.bits)
            k = np.searchsorted(self.grams, short)
            k[k == len(self.grams)] = 0
            rank = np.where(self.grams[k] == short, self.classes[k], rank)
        return rank


def _table_parts(bits: int, wide: int):
    """(at, part): bytes of a table of 2**wide bits, those of the n-grams of each batch set."""

    def run(batches):
        for batch in batches:
            cells = np.unique(batch["gram"].to_numpy() >> (bits - wide))
            at, parts = [], []
            for some in np.split(cells, np.flatnonzero(np.diff(cells) > 1 << 16) + 1) if len(cells) else []:
                flags = np.zeros(8 * ((some[-1] >> 3) - (some[0] >> 3) + 1), bool)
                flags[some - (some[0] >> 3 << 3)] = True
                at.append(some[0] >> 3)
                parts.append(np.packbits(flags).tobytes())
            yield pa.record_batch([pa.array(at, pa.int64()), pa.array(parts, pa.binary())], ["at", "part"])

    return run


def gram_order(docs: DataFrame, bits: int, n_buckets: int, n: int, most: int | None = None) -> Order:
    """The order of n-grams by their frequencies over all of docs.

    The driver and the tasks know the frequencies of at most `most` n-grams: those that have a power of two at least, the least
    that leaves so few. In a larger corpus that power is higher, and n-grams below it are many of those that any document has;
    of them a table of bits tells the frequent ones from the rare.
    """
    # a bucket a task: by hashes of the numbers some tasks would have several
    counts = docs.mapInArrow(_gram_counts(bits, n_buckets, n), "bucket int, body binary").repartitionById(n_buckets, "bucket")
    counts = written(counts.mapInArrow(_gram_sums, "gram bigint, c tinyint"), "grams")
    least, left, rest = 63, 0, 0
    for r in sorted(counts.groupBy("c").count().collect(), reverse=True):
        if not rest and left + r["count"] <= (GRAMS if most is None else most):
            least, left = r.c, left + r["count"]
        elif r.c >= OFTEN:
            rest += r["count"]
        else:
            break
    got = counts.where(F.col("c") >= least).toArrow()
    grams, c = got["gram"].to_numpy().view(np.uint64), got["c"].to_numpy()
    order = np.argsort(grams)
    wide, table = min(TABLE, max(3, math.ceil(math.log2(SPARSE * max(1, rest))))), np.empty(0, np.uint8)
    if rest:
        table = np.zeros(1 << wide - 3, np.uint8)
        parts = counts.where((F.col("c") >= OFTEN) & (F.col("c") < least)).select("gram").mapInArrow(_table_parts(bits, wide), "at bigint, part binary").toArrow()
        for batch in parts.to_batches():
            for at, part in zip(batch["at"].to_pylist(), batch["part"].to_pylist()):
                table[at : at + len(part)] |= np.frombuffer(part, np.uint8)
    return Order(bits, grams[order], c[order].astype(np.uint8), wide, table)


def needed(m, least: float):
    """The least overlap with any set within the threshold, of a set of m n-grams."""
    return np.ceil(np.asarray(m) * least - 1e-9).astype(np.int64)


def more(m):
    """n-grams of a prefix beyond what one shared n-gram needs: SHARED, or an eighth of a large set."""
    return np.maximum(SHARED, np.asarray(m) // 8)


def shares(small, large, least: float) -> tuple:
    """(s, l): of the n-grams that a pair with sets of these sizes shares in its prefixes, s are rare or else l are common."""
    all_of = np.minimum(more(small), needed(large, least))
    rare = (all_of + 3) // 4
    return rare, all_of - rare + 1


def _prefixes(order_of: Order, least: float, n: int, n_buckets: int):
    """(bucket, body): prefixes of sets, parted by ranges of keys."""
    wide = min(64, order_of.bits + 8)

    def run(batches):
        keys, own, ids, sizes, held = [], [], [], [], 0

        def flush():
            nonlocal held
            key, doc = np.concatenate(keys or [np.empty(0, np.uint64)]), np.repeat(np.arange(len(ids)), own)
            i, m = np.array(ids, np.int64), np.array(sizes, np.int64)
            order = np.argsort(key)
            key, doc = key[order], doc[order]
            cut, out = _cut(key, wide, n_buckets), []
            for b in range(n_buckets):
                some = slice(cut[b], cut[b + 1])
                if cut[b + 1] > cut[b]:
                    docs, at = np.unique(doc[some], return_inverse=True)
                    out.append((b, pack(_planes(np.diff(key[some], prepend=np.uint64(0))), _planes(at.astype(np.uint32)), _planes(np.diff(i[docs], prepend=0)), _planes(m[docs].astype(np.uint32)))))
            for x in (keys, own, ids, sizes):
                x.clear()
            held = 0
            return rows(out, BODIES)

        for batch in batches:
            doc_ids = batch["doc_id"].to_pylist()
            for at, some in _blocks(batch):
                block = Block(some, n)
                h = block.gram_hashes()
                rank = order_of.ranks(h)
                ends = np.cumsum(block.grams).tolist()
                for i, a, b in zip(at, [0, *ends], ends):
                    s, first = np.unique(h[a:b], return_index=True)
                    ids.append(doc_ids[i])
                    sizes.append(len(s))
                    p = max(0, len(s) - int(needed(len(s), least)) + int(more(len(s)))) if len(s) else 0
                    c = rank[a:b][first]
                    # the rarest first; sets are in order of hashes, which orders those of a class
                    s = s[np.argsort(c, kind="stable")[:p]] if c.any() else s[:p]
                    keys.append(s >> np.uint64(64 - wide))
                    own.append(len(s))
                    held += len(s)
                if held > HELD or len(ids) > HELD // 16:
                    yield flush()
        if ids:
            yield flush()

    return run


def _summed(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (p, x, least): each p and x once, with the least and the number of rows."""
    p, x, least = np.concatenate(rows).T if rows else np.empty((3, 0), np.int64)
    order = np.lexsort((x, p))
    p, x, least = p[order], x[order], least[order]
    starts = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (x[1:] != x[:-1])]) if len(p) else np.empty(0, np.int64)
    return p[starts], x[starts], np.minimum.reduceat(least, starts) if len(starts) else least, np.diff(np.r_[starts, len(p)])


def _meet(least: float):
    """Of the prefixes of one partition: pairs with the number of rare n-grams they share (kind 0), and members of regions (1)."""

    def run(batches):
        keys, docs, sizes = [], [], []
        for batch in batches:
            for body in batch["body"]:
                k, at, ids, m = unpack(body.as_buffer())
                at = _numbers(at, np.uint32)
                keys.append(np.cumsum(_numbers(k, np.uint64), dtype=np.uint64))
                docs.append(np.cumsum(_numbers(ids, np.int64))[at])
                sizes.append(_numbers(m, np.uint32)[at])
        if not keys:
            return
        key, doc, m = np.concatenate(keys), np.concatenate(docs), np.concatenate(sizes).astype(np.int64)
        del keys, docs, sizes
        order = np.lexsort((doc, key))
        key, doc, m = key[order], doc[order], m[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        n = np.diff(np.r_[starts, len(key)])
        pairs, members = [], []
        for g in range(2, SMALL + 1):
            at = starts[n == g]
            for i in range(g):
                for j in range(i + 1, g):
                    a, b = at + i, at + j
                    ok = (doc[a] != doc[b]) & (np.minimum(m[a], m[b]) >= needed(np.maximum(m[a], m[b]), least))
                    a, b = a[ok], b[ok]
                    pairs.append(np.stack([doc[a], doc[b], shares(np.minimum(m[a], m[b]), np.maximum(m[a], m[b]), least)[0]], 1))
        large = n > SMALL
        # its two least documents name a region: of one alone, those of all its n-grams would be a large one
        at = starts[large]
        name = _mix(_mix(doc[at].view(np.uint64)) + doc[at + 1].view(np.uint64)).view(np.int64)
        inside = np.repeat(large, n)
        members.append(np.stack([np.repeat(name, n[large]), doc[inside], shares(needed(m[inside], least), m[inside], least)[1]], 1))
        for kind, found in enumerate((pairs, members)):
            columns = _summed(found)
            for at in range(0, len(columns[0]), 100_000):
                some = [c[at : at + 100_000] for c in columns]
                yield pa.record_batch([*some, np.full(len(some[0]), kind, np.int8)], names=MET)

    return run


def _mark(grams: np.ndarray) -> bytes:
    """What stands for a whole set."""
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _sized(n: int):
    """(v, mark, m, cost): of each document the mark and the size of its set, and what counts of it for CELL."""

    def run(batches):
        for batch in batches:
            sets = []
            for _, some in _blocks(batch):
                block = Block(some, n)
                sets += [(_mark(s), len(s)) for s in block.sets(block.gram_hashes())]
            m = np.array([m for _, m in sets], np.int64)
            cost = np.maximum(m, pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 8)
            yield pa.record_batch([batch["doc_id"], pa.array([x for x, _ in sets], pa.binary()), pa.array(m), pa.array(cost)], ["v", "mark", "m", "cost"])

    return run


def _marked(n: int):
    """Rows with the mark of the text's set."""

    def run(batches):
        for batch in batches:
            marks = []
            for _, some in _blocks(batch):
                block = Block(some, n)
                marks += [_mark(s) for s in block.sets(block.gram_hashes())]
            yield pa.record_batch([batch["doc_id"], batch["text"], pa.array(marks, pa.binary())], ["doc_id", "text", "mark"])

    return run


class Cell:
    """Sets that may be joined with each other, as an incidence of documents and the n-grams that several of them have."""

    def __init__(self, sets: list[np.ndarray], free: bool = False):
        """free: sets is emptied as soon as it is copied."""
        self.size = np.array([len(s) for s in sets], np.int64)
        key = np.concatenate(sets)
        if free:
            sets.clear()
        # np.unique with what it returns takes several times the memory
        order = np.argsort(key).astype(np.int32 if len(key) < 1 << 31 else np.int64)
        key = key[order]
        new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        del key
        several = np.diff(np.r_[np.flatnonzero(new), len(new)]) > 1
        number = np.where(several, np.cumsum(several) - 1, -1).astype(np.int32)
        gram = np.empty(len(order), np.int32)
        gram[order] = number[np.cumsum(new, dtype=np.int32) - 1]
        del order, new
        keep = gram >= 0
        self.gram, self.grams = gram[keep], int(several.sum())
        self.ends = np.r_[0, np.cumsum(keep)][np.r_[0, np.cumsum(self.size)]]

    def part(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of docs, n-gram) of some documents."""
        n = self.ends[docs + 1] - self.ends[docs]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.ends[docs], n)
        return np.repeat(np.arange(len(docs)), n), self.gram[at]

    def overlaps(self, a: np.ndarray, b: np.ndarray, wide: int = 4096) -> np.ndarray:
        """Sizes of the intersections of documents a with documents b, by products of dense blocks of the incidence."""
        rb, gb = self.part(b)
        if len(b) <= 16:
            out = np.zeros((len(a), len(b)), np.int64)
            own = np.zeros((len(b), self.grams), bool)
            own[rb, gb] = True
            upto = np.cumsum(self.ends[a + 1] - self.ends[a])
            for at in np.split(np.arange(len(a)), np.flatnonzero(np.diff(upto // PART)) + 1):
                ra, ga = self.part(a[at])
                for j in range(len(b)):
                    out[at, j] = np.bincount(ra[own[j][ga]], minlength=len(at))
            return out
        ra, ga = self.part(a)
        # only n-grams that both sides have matter
        has = [np.zeros(self.grams, bool) for _ in range(2)]
        has[0][ga], has[1][gb] = True, True
        both = has[0] & has[1]
        number = np.cumsum(both) - 1
        ra, rb, ga, gb = ra[both[ga]], rb[both[gb]], number[ga[both[ga]]], number[gb[both[gb]]]
        out = np.zeros((len(a), len(b)), np.float32)
        if (several := int(both.sum())) < wide:
            wide = max(1, several)
        for at in range(0, several, wide):
            x, y = (np.zeros((len(d), wide), np.float32) for d in (a, b))
            for z, r, g in ((x, ra, ga), (y, rb, gb)):
                some = (g >= at) & (g < at + wide)
                z[r[some], g[some] - at] = 1
            out += x @ y.T
        return out.round().astype(np.int64)

    def distances(self, docs: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        """Jaccard distances of docs to each of the pivots."""
        o = self.overlaps(docs, pivots)
        return 1 - o / (self.size[docs][:, None] + self.size[pivots][None] - o)


def _leaf(cell: Cell, docs: np.ndarray, near: np.ndarray, least: float, tell, side: np.ndarray | None = None) -> None:
    """All pairs of docs, or those of both sides; blocks in order of the distance to a pivot, and pairs of blocks that lie apart are
    left out."""
    order, r = np.argsort(near, kind="stable"), 1 - least + 1e-9
    docs, near = docs[order], near[order]
    halves = [(docs, near)] * 2 if side is None else [(docs[side[docs] == k], near[side[docs] == k]) for k in (False, True)]
    (first, d), (second, e) = halves
    for i in range(0, len(first), LEAF):
        a = first[i : i + LEAF]
        for j in range(i if side is None else 0, len(second), LEAF):
            b = second[j : j + LEAF]
            if e[j] - d[i + len(a) - 1] > r:
                break
            if d[i] - e[j + len(b) - 1] > r:
                continue
            o = cell.overlaps(a, b)
            u = cell.size[a][:, None] + cell.size[b][None] - o
            x, y = np.nonzero(o >= np.ceil(u * least - 1e-9))
            ok = (x < y) if side is None and i == j else np.ones(len(x), bool)
            x, y = x[ok], y[ok]
            tell(a[x], b[y], o[x, y], u[x, y])


def _join(cell: Cell, docs: np.ndarray, least: float, tell, depth: int = 0, side: np.ndarray | None = None) -> None:
    """All pairs of docs within the threshold, each once: told in the first of the cells where its documents are at home. Voronoi
    cells of a few pivots, each farthest from those before, and the documents that the triangle inequality lets have a partner
    there; a cell that is hardly smaller isn't split again. side: only pairs of documents of which one has it and one hasn't."""
    if len(docs) < 2 or side is not None and side[docs].all() == side[docs].any():
        return
    pivots = [docs[0]]
    d = cell.distances(docs, np.array(pivots))
    if len(docs) <= LEAF:
        return _leaf(cell, docs, d[:, 0], least, tell, side)
    for _ in range(min(15, len(docs) // LEAF + 1)):
        far = d.min(1).argmax()
        if d[far].min() <= 0:
            break
        pivots.append(docs[far])
        d = np.concatenate([d, cell.distances(docs, np.array(pivots[-1:]))], 1)
    home, own = d.argmin(1), d.min(1)
    r = 1 - least + 1e-9
    homes = np.full(len(cell.size), -1)
    homes[docs] = home

    def first(k: int):
        def told(a, b, o, u):
            ok = np.minimum(homes[a], homes[b]) == k
            tell(a[ok], b[ok], o[ok], u[ok])

        return told

    for k in range(len(pivots)):
        at_home = home == k
        if not at_home.any():
            continue
        # a partner at home here is within r: no farther from the pivot than its farthest resident and r, nor, being nearer to
        # this pivot than to the document's own, than the document's own distance and twice r
        window = at_home | (d[:, k] <= own[at_home].max() + r) & (d[:, k] <= own + 2 * r)
        some = docs[window]
        if len(some) > 0.7 * len(docs) or depth > 20:
            _leaf(cell, some, d[window, k], least, first(k), side)
        else:
            _join(cell, some, least, first(k), depth + 1, side)


def join_sets(sets: list[np.ndarray], least: float = LEAST) -> list[tuple[int, int, int, int]]:
    """(i, j, overlap, union) for all pairs of sets whose Jaccard is at least `least`, each once, i < j."""
    out: list[tuple[int, int, int, int]] = []

    def tell(a, b, o, u):
        out.extend(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), o.tolist(), u.tolist()))

    if sets:
        _join(Cell(sets), np.arange(len(sets)), least, tell)
    return sorted(out)


def _region(least: float, n: int):
    """Of the sets of one region, or of two of its blocks: the links told there, as their number for each (with mark) and as edges
    (without) that connect what they connect. A pair that meets in several regions counts in the least one."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("mark", pa.binary()), ("links", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        # a row that repeats a document and its set counts once
        once = {(i, t): k for k, (i, t) in enumerate(zip(table["x"].to_pylist(), table["mark"].to_pylist()))}
        if len(once) < len(table):
            table = table.take(pa.array(list(once.values()), pa.int64()))
        ids, own, sets = table["x"].to_numpy(), int(table["p"][0].as_py()), []
        side = table["block"].to_numpy() == table["i"][0].as_py() if table["i"][0].as_py() != table["j"][0].as_py() else None
        for batch in table.select(["text"]).to_batches():
            for _, some in _blocks(batch):
                part = Block(some, n)
                sets += part.sets(part.gram_hashes())
        lists: dict[tuple, int] = {}
        kind = np.array([lists.setdefault(tuple(sorted(x)), len(lists)) for x in table["regions"].to_pylist()], np.int64)
        lists_of = list(lists)
        owned: dict[int, bool] = {}
        links = Links(table["weight"].to_numpy())

        def tell(a, b, o, u):
            if len(lists) > 1 or len(lists_of[0]) > 1:
                both, at = np.unique(kind[a] * len(lists) + kind[b], return_inverse=True)
                for k in both.tolist():
                    if k not in owned:
                        owned[k] = min({*lists_of[k // len(lists)]} & {*lists_of[k % len(lists)]}) == own
                ok = np.array([owned[k] for k in both.tolist()], bool)[at]
                a, b = a[ok], b[ok]
            links.tell(a, b)

        _join(Cell(sets, free=True), np.arange(len(ids)), least, tell, side=side)
        some, lower = np.flatnonzero(links.n), np.flatnonzero(links.label != np.arange(len(ids)))
        nulls = pa.nulls(len(some), pa.int64()), pa.nulls(len(lower), pa.binary()), pa.nulls(len(lower), pa.int64())
        counts = [pa.array(ids[some]), nulls[0], table["mark"].take(pa.array(some)).combine_chunks(), pa.array(links.n[some])]
        edges = [pa.array(ids[lower]), pa.array(ids[links.label[lower]]), nulls[1], nulls[2]]
        return pa.concat_tables([pa.table(x, schema=schema) for x in (counts, edges)])

    return run


def _few(ids: DataFrame, most: int = BROADCAST) -> DataFrame:
    """A list of ids to join texts with: sent to all tasks only while it is small; beyond that the texts are shuffled to it."""
    return F.broadcast(ids) if ids.count() <= most else ids


def _several(stars: DataFrame) -> DataFrame:
    """Members of regions (p, x, n, least) that can share enough there, with all n-grams of x and the size of p.

    A pair shares `least` common n-grams of each of its documents, in regions where both are. So regions of one document don't
    count, nor do documents with too few n-grams in the others, and leaving them out can leave others alone.
    """
    of = Window.partitionBy("x")
    for k in range(ROUNDS):
        stars = stars.select("*", F.sum("n").over(of).alias("all")).withColumn("least", F.min("least").over(of)).where("all >= least")
        stars = written(stars, "stars")
        if k + 1 < ROUNDS:
            stars = stars.select("p", "x", "n", "least").join(stars.groupBy("p").agg(F.count("x").alias("size")).where("size > 1"), "p")
    return stars


def _crossed(stars: DataFrame) -> DataFrame:
    """Members (p, x, n) of regions that are needed for all pairs with enough common n-grams to meet.

    Texts are sent to each of them, so regions of up to MIDDLE documents are left to the pairs that can share enough: the n-grams
    they share in such regions, and those in larger ones, are counted. A pair that only larger ones hold meets without them.
    """
    stars = _several(stars)
    few, many = stars.where(F.col("size") <= MIDDLE), stars.where(F.col("size") > MIDDLE)
    few = few.join(many.groupBy("x").agg(F.sum("n").alias("rest")), "x", "left").select("p", "x", "n", "least", F.coalesce("rest", F.lit(0)).alias("rest"))
    other = few.select("p", *(F.col(c).alias(f"{c}_") for c in ("x", "n", "least", "rest")))
    pairs = few.join(other, "p").where("x < x_").groupBy("x", "x_").agg(F.sum(F.least("n", "n_")).alias("shared"), F.min(F.struct("p", "n", "n_")).alias("at"), F.max(F.greatest("least", "least_")).alias("least"), F.max(F.least("rest", "rest_")).alias("rest"))
    pairs = written(pairs.where("shared + rest >= least").select("x", "x_", "at.*"), "crossed")
    # of what is left a document needs no region after all but `least` - 1 of its n-grams, in one order for all documents: had it
    # left the first that a pair shares, the pair would share fewer; small regions come first
    many = _several(many.select("p", "x", "n", "least"))
    before = F.sum("n").over(Window.partitionBy("x").orderBy("size", "p")) - F.col("n")
    many = many.withColumn("before", before).where("before <= all - least")
    return pairs.select("p", "x", "n").unionByName(pairs.select("p", F.col("x_").alias("x"), F.col("n_").alias("n"))).distinct().unionByName(many.select("p", "x", "n"))


def _in_blocks(own: DataFrame) -> DataFrame:
    """Members (p, x, mark, block, blocks) of regions of several: one too large for a task is joined block by block, each pair of
    blocks in a task of its own."""
    half = max(1, CELL // 2)
    # none counts for more than a block, so no block is empty
    cost = F.least(F.greatest("cost", F.lit(max(1, CELL // REGION))), F.lit(half))
    of = Window.partitionBy("p")
    own = own.withColumn("cost", cost).select("*", F.count("x").over(of).alias("count"), F.sum("cost").over(of).alias("all"), (F.sum("cost").over(of.orderBy("x", "mark")) - F.col("cost")).alias("before"))
    own = own.where("count > 1").withColumn("block", F.when(F.col("all") <= CELL, 0).otherwise(F.floor(F.col("before") / half)).cast("int"))
    return own.select("p", "x", "mark", "block", (F.max("block").over(of) + 1).alias("blocks"))


def _linked(docs: DataFrame, least: float, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members (id, v, mark, m, cost): of each document and distinct set the least document with that set; counts (id, mark, links) of
    sets with links to others, edges (a, b) that connect what links connect)."""
    k, known = buckets(docs), docs.where("doc_id is not null")
    bits = min(56, max(32, math.ceil(math.log2(max(1, input_bytes(docs)))) + 3))
    # equal sets are one: the least document stands for them
    marks = written(known.mapInArrow(_sized(n), "v bigint, mark binary, m bigint, cost bigint"), "marks").groupBy("v", "mark", "m").agg(F.sum("cost").alias("cost"))
    first = marks.where("m > 0").groupBy("mark").agg(F.min("v").alias("id"), F.count("v").alias("weight"))
    first = written(first, "first")
    members = written(marks.join(first.select("mark", "id"), "mark", "left").select("id", "v", "mark", "m", "cost"), "members")
    # the others don't meet any: else n-grams of one text would be as frequent as its copies, and all of its regions full of them
    copies = written(members.groupBy("v").agg(F.max(F.col("id") == F.col("v")).alias("first")).where("not first").select(F.col("v").alias("doc_id")), "copies")
    count, one = copies.count(), known
    if count:
        one = known.join(_few(copies), "doc_id", "left_anti")
    if count > BROADCAST:
        one = written(one, "one")
    met = one.mapInArrow(_prefixes(gram_order(one, bits, k, n), least, n, k), "bucket int, body binary").repartitionById(k, "bucket").mapInArrow(_meet(least), "p bigint, x bigint, least bigint, n bigint, kind tinyint")
    met = written(met, "met")
    # a pair shares enough rare n-grams, or each of its documents has enough common ones
    met = met.groupBy("p", "x", "kind").agg(F.min("least").alias("least"), F.sum("n").alias("n"))
    met = written(met.withColumn("enough", F.col("n") >= F.col("least")).where("kind = 1 or enough"), "candidates")
    pairs, stars = met.where("kind = 0"), met.where("kind = 1")
    own = [pairs.select("p", "x", "n"), pairs.select("p", F.col("p").alias("x"), "n"), _crossed(stars)]
    # texts of one document are no pair, but meet too
    own.append(marks.groupBy("v").count().where("count > 1").select(F.col("v").alias("p"), F.col("v").alias("x"), F.lit(0).cast("bigint").alias("n")))
    least_of = members.where("id is not null").select(F.col("v").alias("x"), "id", "mark", "cost")
    regions = own[0].unionByName(own[1]).unionByName(own[2]).join(least_of, "x")
    regions = written(regions.groupBy("p", F.col("id").alias("x"), "mark").agg(F.max("n").alias("n"), F.max("cost").alias("cost")), "regions")
    # regions whose pivots share many n-grams are one, so that a cluster of copies is joined once and not for each of its pivots
    labels = components(regions.where(F.col("n") >= STRONG).select(F.col("p").alias("a"), F.col("x").alias("b"))).select(F.col("a").alias("p"), "label")
    own = regions.join(labels, "p", "left").groupBy(F.coalesce("label", "p").alias("p"), "x", "mark").agg(F.max("cost").alias("cost"))
    own = written(_in_blocks(written(own, "own")), "own")
    of = own.groupBy("x", "mark").agg(F.collect_set("p").alias("regions")).join(first.select("mark", "weight"), "mark")
    spread = own.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = written(spread.select("p", F.least("block", "j").alias("i"), F.greatest("block", "j").alias("j"), "block", "x", "mark").join(of, ["x", "mark"]), "spread")
    wanted = spread.select(F.col("x").alias("doc_id")).distinct()
    alone = known.join(_few(wanted), "doc_id", "left_semi").mapInArrow(_marked(n), "doc_id bigint, text string, mark binary")
    near = alone.withColumnRenamed("doc_id", "x").join(_few(spread, BROADCAST // 8), ["x", "mark"]).repartition(k, "p", "i", "j").groupBy("p", "i", "j").applyInArrow(_region(least, n), "a bigint, b bigint, mark binary, links bigint")
    near = written(near, "near")
    return members, near.where("mark is not null").groupBy(F.col("a").alias("id"), "mark").agg(F.sum("links").alias("links")), near.where("mark is null").select("a", "b")


def _groups(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, label): the least document that links or copies connect each document with, of those that have any."""
    return components(edges.unionByName(members.where("id != v").select(F.col("id").alias("a"), F.col("v").alias("b"))))


def jaccard_links(docs: DataFrame, least: float = LEAST, n: int = N) -> DataFrame:
    """(doc_id, class_id, links) for every document: how many others have a set of word n-grams within a Jaccard of `least` of its
    own, and the least document that such links connect it with, over others maybe: itself, if it has none.

    Words are parted by white space and compared in lower case. A text of fewer than n words is one n-gram; null texts and
    those without a word have no links, not even to each other. Rows of null doc_id are left out. Rows that repeat a doc_id and
    its n-grams count as one; a doc_id with several different texts counts as a document for each of them, all of one class, whose
    links are added up. An empty table gives an empty one; columns other than doc_id and text aren't read.
    """
    members, counts, edges = _linked(texts(docs), least, n)
    copies = members.where("id is not null").groupBy("id", "mark").agg((F.count("v") - 1).alias("copies"))
    links = members.join(copies, ["id", "mark"], "left").join(counts, ["id", "mark"], "left").groupBy(F.col("v").alias("doc_id")).agg(F.sum(F.coalesce("copies", F.lit(0)) + F.coalesce("links", F.lit(0))).alias("links"))
    labels = _groups(members, edges).select(F.col("a").alias("doc_id"), "label")
    return links.join(labels, "doc_id", "left").select("doc_id", F.coalesce("label", "doc_id").alias("class_id"), "links")


def duplicates(docs: DataFrame, least: float = LEAST, n: int = N) -> DataFrame:
    """(doc_id, kept): the documents that go if of each group, connected by links, only the least doc_id stays."""
    members, _, edges = _linked(texts(docs), least, n)
    return _groups(members, edges).where("a != label").select(F.col("a").alias("doc_id"), F.col("label").alias("kept"))


def keep_one(docs: DataFrame, least: float = LEAST, n: int = N) -> DataFrame:
    """docs with one row of each group of near duplicates: the least doc_id of the group. Of rows with one doc_id and one text
    one stays; those of one doc_id and several texts stay or go together. Rows of null doc_id stay."""
    kept = docs.join(_few(written(duplicates(docs, least, n).select("doc_id"), "gone")), "doc_id", "left_anti").select(docs.columns)
    again = written(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return kept
    return kept.join(_few(again), "doc_id", "left_anti").select(docs.columns).unionByName(kept.join(_few(again), "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"]))


#: The same by counting shared n-grams of all documents, and by following links.
ORACLE = f"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < {N} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {N - 2}), lambda i: array_to_string(w[i:i + {N - 1}], ' ')) END) AS g FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS m FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
pairs AS (SELECT doc_a, doc_b FROM shared JOIN sizes x ON x.doc_id = doc_a JOIN sizes y ON y.doc_id = doc_b WHERE o >= {LEAST} * (x.m + y.m - o) - 1e-9),
reached AS (SELECT doc_a, doc_b FROM pairs UNION SELECT r.doc_a, p.doc_b FROM reached r JOIN pairs p ON r.doc_b = p.doc_a)
SELECT doc_id, least(doc_id, coalesce((SELECT min(doc_b) FROM reached r WHERE r.doc_a = d.doc_id), doc_id)) AS class_id, (SELECT count(*) FROM pairs p WHERE p.doc_a = d.doc_id) AS links
FROM documents d WHERE doc_id IS NOT NULL
"""
