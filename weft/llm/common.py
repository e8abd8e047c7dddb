"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a new local one where it is unset (tests, local mode)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="weft-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read again: its lineage is cut, and a lost executor costs nothing."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def input_bytes(df: DataFrame) -> int:
    """Bytes of a plan's inputs as Catalyst knows them, before any join multiplies them; 0 for those of unknown size."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return sum(x for x in sizes if x < 1 << 60)


def buckets(df: DataFrame, each: int = 16 << 20) -> int:
    """Shuffle buckets for df: one for every `each` bytes, and no fewer than the session's shuffle partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(input_bytes(df) / each))


#: Rows of documents that Python workers are sent at once; Spark's 10,000 are many megabytes of text for each worker and its JVM.
BATCH = 2_000


def small_batches(spark: SparkSession) -> None:
    """Batches of BATCH rows for Python workers, unless the session has a number of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH))


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of a table of documents; whatever other columns it has can't clash with an operator's own."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pack(*blobs: bytes) -> bytes:
    """Several byte strings as one compressed one, for rows that carry whole arrays through a shuffle."""
    import zstandard

    head = np.array([len(blobs), *map(len, blobs)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(blobs))


def unpack(packed: bytes) -> list[memoryview]:
    import zstandard

    whole = memoryview(zstandard.ZstdDecompressor().decompress(packed))
    n = int(np.frombuffer(whole[:8], np.int64)[0])
    ends = np.cumsum([8 * (n + 1), *np.frombuffer(whole[8 : 8 * (n + 1)], np.int64)])
    return [whole[a:b] for a, b in zip(ends, ends[1:])]


def rows(batch: list, schema) -> "object":
    """An Arrow batch of a list of tuples."""
    import pyarrow as pa

    columns = zip(*batch) if batch else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def hashed_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows of df, those of the least hashes of `key`: the same rows at every run and partitioning. Only keys
    reach the driver's merge, so its size is bounded by `most`."""
    ids = df.select(F.col(key).alias("_k")).where("_k is not null").groupBy("_k").agg(F.xxhash64("_k").alias("_h"))
    ids = ids.orderBy("_h", "_k").limit(most).select("_k")
    return df.join(F.broadcast(ids), F.col(key) == F.col("_k"), "left_semi")


class Links:
    """Links between n documents as they are told: their number for each document, and which documents they connect."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.n = weights, np.zeros(len(weights), np.int64)
        self.label = np.arange(len(weights))

    def tell(self, a: np.ndarray, b: np.ndarray) -> None:
        np.add.at(self.n, a, self.weights[b])
        np.add.at(self.n, b, self.weights[a])
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            least = np.minimum(x, y)[apart]
            np.minimum.at(self.label, x[apart], least)
            np.minimum.at(self.label, y[apart], least)
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]


def components(edges: DataFrame) -> DataFrame:
    """(a, label): the least vertex that edges (a, b) connect each vertex with."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "edges")
    # labels fall to the least of the neighbours', then to the label of the label, until none falls any more
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("label")), "labels")
    while True:
        lower = both.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("lower"))
        step = labels.join(lower, "a").select("a", "label", F.least("label", "lower").alias("new"))
        jump = labels.select(F.col("a").alias("new"), F.col("label").alias("further"))
        new = written(step.join(jump, "new", "left").select("a", "label", F.least("new", F.coalesce("further", "new")).alias("new")), "labels")
        labels = new.select("a", F.col("new").alias("label"))
        if new.where("new != label").isEmpty():
            return labels
