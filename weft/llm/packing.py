"""Best-fit packing of documents into training sequences of several permitted lengths.

Which pieces share a sequence depends on their lengths alone, so the packing itself is made over the histogram of lengths,
whose size is bounded by the largest permitted length and not by the corpus: pieces of one length are placed together, into
classes of equal bins. The plan is then joined to the pieces by length and rank within the length. The bins are those that
best-fit decreasing would make piece by piece.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm import pretokens
from weft.llm.common import texts, written

#: Permitted sequence lengths, and what a sequence costs besides its length.
CAPACITIES, OVERHEAD = (1024, 2048, 4096, 8192), 64


def open_size(length: int, capacities: tuple[int, ...], overhead: int) -> int:
    """The bin size of least cost per token, if filled with pieces of this length; of equals the smallest."""
    fit = [c for c in capacities if c >= length]
    return min(fit, key=lambda c: ((c + overhead) / (length * (c // length)), c))


def plan(counts: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[list[tuple], list[tuple]]:
    """Best-fit decreasing over a histogram {length: number of pieces}, lengths from 1 to the largest capacity.

    Returns (placements, bins). A placement (length, first, last, q, bin, offset): pieces of ranks first..last-1 of that length
    go, q to each bin, into bins `bin`, bin + 1, ... from that offset on. bins: (bin, n, filled, capacity) of runs of equal
    bins, each downsized to the smallest permitted size that holds its contents.
    """
    capacities = tuple(sorted(capacities))
    free: list[tuple[int, int, int, int]] = []  # (room left, first bin, bins, size), sorted: the tightest class first
    placements, bins, unused = [], [], 0
    for length in sorted(counts, reverse=True):
        n, at = counts[length], 0
        while at < n:
            k = bisect_left(free, (length,))
            if k < len(free):
                room, first, m, size = free.pop(k)
            else:
                size = open_size(length, capacities, overhead)
                room, first, m = size, unused, -(-(n - at) // (size // length))
                unused += m
            q = room // length
            full = min(m, (n - at) // q)
            for q, own, start in ((q, full, first), (min(n - at - full * q, q), 1, first + full)):
                if own and q and start < first + m and at < n:
                    placements.append((length, at, at + own * q, q, start, size - room))
                    at += own * q
                    insort(free, (room - q * length, start, own, size))
                    m, first = first + m - (start + own), start + own
            if m:
                insort(free, (room, first, m, size))
    for room, first, m, size in free:
        bins.append((first, m, size - room, next(c for c in capacities if c >= size - room)))
    return placements, bins


def lengths(docs: DataFrame, vocabulary: str = pretokens.BPE_FILE) -> DataFrame:
    """(doc_id, n): the tokens of each text and one more that ends it."""

    def count(batches):
        import pyarrow as pa

        n = pretokens.Counts(vocabulary)
        for batch in batches:
            yield pa.record_batch([batch["doc_id"], pa.array([n(x.as_py()) + 1 for x in batch["text"]], pa.int64())], ["doc_id", "n"])

    return texts(docs).mapInArrow(count, "doc_id bigint, n bigint")


def pack_lengths(sizes: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bin, bin_offset, capacity) from sizes (doc_id, n).

    A document longer than the largest capacity is cut into pieces of it and a rest; piece numbers them, start is the first
    token of the piece. Rows of n null or under 1 hold nothing and aren't packed. Repeated rows and null doc_ids are packed
    like others; equal pieces may change places between two runs. An empty table gives an empty one.
    """
    spark, most = sizes.sparkSession, max(capacities)
    cut = F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {most}").cast("int"))).alias("piece")
    pieces = sizes.where("n >= 1").select("doc_id", "n", cut).select("doc_id", "piece", (F.col("piece").cast("bigint") * most).alias("start"), F.least(F.lit(most), F.col("n") - F.col("piece").cast("bigint") * most).cast("int").alias("n_tokens"))
    counts = {r.n_tokens: r["count"] for r in pieces.groupBy("n_tokens").count().collect()}  # at most `most` rows
    placements, bins = plan(counts, capacities, overhead)
    size = {}
    for first, m, filled, capacity in bins:
        size[first] = (first + m, capacity)
    firsts = sorted(size)
    steps = []
    for length, a, b, q, start, offset in placements:  # cut where bins that began together end in different classes
        k = max(0, bisect_left(firsts, start + 1) - 1)
        last = start + (b - a) // q
        while start < last:
            end, capacity = size[firsts[k]]
            m = min(end, last) - start
            steps.append((length, a, a + m * q, q, start, offset, capacity))
            a, start, k = a + m * q, start + m, k + 1
    schema = "n_tokens int, a bigint, b bigint, q bigint, first bigint, at int, capacity int"
    table = spark.createDataFrame(pd.DataFrame(steps, columns=[x.split()[0] for x in schema.split(", ")]), schema) if steps else spark.createDataFrame([], schema)
    ranked = pieces.withColumn("r", F.row_number().over(Window.partitionBy("n_tokens").orderBy("doc_id", "piece")).cast("bigint") - 1)
    # the plan is bounded by the capacities and not by the corpus; a piece finds its step by a range within its length
    placed = ranked.join(F.broadcast(table), (ranked.n_tokens == table.n_tokens) & (ranked.r >= table.a) & (ranked.r < table.b))
    nth = F.col("r") - F.col("a")
    return placed.select(ranked.doc_id, "piece", "start", ranked.n_tokens, (F.col("first") + F.floor(nth / F.col("q"))).alias("bin"), (F.col("at") + (nth % F.col("q")) * ranked.n_tokens).alias("bin_offset"), "capacity")


def best_fit_packing(docs: DataFrame, vocabulary: str = pretokens.BPE_FILE, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """pack_lengths over the token counts of docs, each with one token more for the end of the document: null and empty texts
    are packed as that token alone."""
    return pack_lengths(written(lengths(docs, vocabulary), "lengths"), capacities, overhead)
