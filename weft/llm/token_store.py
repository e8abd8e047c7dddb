"""Token ids in a binary store: every document is one zstandard frame, made with a dictionary that all share.

The dictionary is trained on the serialized id arrays of a bounded sample of documents. Frames lie one after another in shards;
an index of (doc_id, shard, offset, length) reads one short document without the rest of its shard, and the hash of the
dictionary in each row says which dictionary its frame needs.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import pretokens
from weft.llm.common import hashed_sample, rows, texts

#: Most documents that the dictionary is trained on, and its bytes.
SAMPLE, DICT_BYTES, LEVEL = 2000, 64 << 10, 3
FRAME = "doc_id bigint, shard bigint, offset bigint, length int, n_tokens int, dict_hash string, frame binary"
FRAMES = pa.schema([("doc_id", pa.int64()), ("shard", pa.int64()), ("offset", pa.int64()), ("length", pa.int32()), ("n_tokens", pa.int32()), ("dict_hash", pa.string()), ("frame", pa.binary())])


class Ids:
    """Serialized ids of whole texts: little-endian, 2 bytes where the vocabulary allows it, else 4."""

    def __init__(self, path: str):
        encoding = pretokens.encoding(path)
        self.dtype = np.dtype("<u2" if encoding.n_vocab <= 1 << 16 else "<u4")
        ids = lambda text: np.array(encoding.encode_ordinary(text), self.dtype).tobytes()
        self.spaced, self.plain = pretokens.Memo(lambda w: ids(" " + w), 600_000), pretokens.Memo(ids, 50_000)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        rest, whole = pretokens.parts(text)
        return b"".join(map(self.plain.__getitem__, whole)) + b"".join(map(self.spaced.__getitem__, rest))


@cache
def _ids(path: str) -> Ids:
    """One in each worker process: what a task has encoded the next one needn't."""
    return Ids(path)


def digest(dictionary: bytes) -> str:
    return hashlib.sha256(dictionary).hexdigest()


def train_dictionary(docs: DataFrame, vocabulary: str = pretokens.BPE_FILE, most: int = SAMPLE, size: int = DICT_BYTES) -> bytes:
    """A zstandard dictionary of at most `size` bytes from the id arrays of at most `most` documents, those of least hash of
    doc_id. Where the sample is too small to train on, its arrays themselves (nothing, if it has none) are the dictionary."""

    def arrays(batches):
        ids = _ids(vocabulary)
        for batch in batches:
            yield pa.record_batch([pa.array([ids(x.as_py()) for x in batch["text"]], pa.binary())], ["ids"])

    got = sorted(r.ids for r in hashed_sample(texts(docs), "doc_id", most).mapInArrow(arrays, "ids binary").collect() if r.ids)
    try:
        return zstandard.train_dictionary(size, [bytes(x) for x in got]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(map(bytes, got))[:size]


@cache
def _dictionary(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def _frames(vocabulary: str, dictionary: bytes, level: int):
    def frames(batches):
        ids, task = _ids(vocabulary), TaskContext.get().partitionId()
        shared, mark = _dictionary(dictionary), digest(dictionary)
        press = zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=True) if shared else zstandard.ZstdCompressor(level=level, write_checksum=True)
        for k, batch in enumerate(batches):
            out, offset = [], 0
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                raw = ids(text.as_py())
                frame = press.compress(raw)
                out.append((doc_id, task << 32 | k, offset, len(frame), len(raw) // ids.dtype.itemsize, mark, frame))
                offset += len(frame)
            yield rows(out, FRAMES)

    return frames


def frames(docs: DataFrame, dictionary: bytes, vocabulary: str = pretokens.BPE_FILE, level: int = LEVEL) -> DataFrame:
    """(doc_id, shard, offset, length, n_tokens, dict_hash, frame) for every row of docs: one pass, no shuffle.

    Null and empty texts are frames of no ids. A repeated row has a frame each time, a null doc_id stays null, an empty table
    gives an empty one; columns other than doc_id and text aren't read. A shard is one Arrow batch.
    """
    return texts(docs).mapInArrow(_frames(vocabulary, dictionary, level), FRAME)


def token_store(docs: DataFrame, vocabulary: str = pretokens.BPE_FILE, most: int = SAMPLE, size: int = DICT_BYTES) -> DataFrame:
    """The store as one table: the rows of frames(), and one row with the trained dictionary as its frame, by its dict_hash; its
    other columns are null. An empty table, whose dictionary is empty, gives an empty one; for the rest see frames()."""
    dictionary = train_dictionary(docs, vocabulary, most, size)
    made = frames(docs, dictionary, vocabulary)
    if not dictionary:
        return made
    own = docs.sparkSession.createDataFrame([(None, None, None, None, None, digest(dictionary), bytearray(dictionary))], made.schema)
    return made.unionByName(own)


def _shards(vocabulary: str, dictionary: bytes, level: int):
    """(shard, payload, entries): the frames of each batch one after another, and where each lies."""
    one = _frames(vocabulary, dictionary, level)
    entry = pa.list_(pa.struct([("doc_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int32()), ("n_tokens", pa.int32())]))

    def shards(batches):
        for batch in one(batches):
            if batch.num_rows:
                entries = [{k: batch[k][i].as_py() for k in ("doc_id", "offset", "length", "n_tokens")} for i in range(batch.num_rows)]
                payload = b"".join(batch["frame"].to_pylist())
                yield pa.record_batch([pa.array([batch["shard"][0].as_py()], pa.int64()), pa.array([payload], pa.binary()), pa.array([entries], entry)], ["shard", "payload", "entries"])

    return shards


def write_store(docs: DataFrame, at: str, vocabulary: str = pretokens.BPE_FILE, most: int = SAMPLE, size: int = DICT_BYTES) -> None:
    """The store as three tables under `at`: shards (shard, payload, entries), index (doc_id, shard, offset, length, n_tokens,
    dict_hash), and dictionaries (dict_hash, dictionary). A narrow pass over docs, and one over the entries of the shards.

    Null doc_ids and repeated ones have an entry for each row; an empty table gives empty shards and an empty index.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, vocabulary, most, size)
    spark.createDataFrame([(digest(dictionary), bytearray(dictionary))], "dict_hash string, dictionary binary").write.parquet(f"{at}/dictionaries")
    made = texts(docs).mapInArrow(_shards(vocabulary, dictionary, LEVEL), "shard bigint, payload binary, entries array<struct<doc_id:bigint,offset:bigint,length:int,n_tokens:int>>")
    # small row groups, so that a reader of some shards skips the others by their statistics
    made.write.option("compression", "none").option("parquet.block.size", 1 << 20).parquet(f"{at}/shards")
    spark.read.parquet(f"{at}/shards").select("shard", F.explode("entries").alias("e")).select("e.*", "shard", F.lit(digest(dictionary)).alias("dict_hash")).write.parquet(f"{at}/index")


def read_store(spark: SparkSession, at: str, ids: list[int]) -> DataFrame:
    """(doc_id, frame, dict_hash) of some documents: the index says in which shards they are and where, other shards' row groups are
    skipped, and only the frames' bytes are decoded. Ids that the store lacks have no row, repeated ones a row for each."""
    index = spark.read.parquet(f"{at}/index").where(F.col("doc_id").isin(ids))
    of = [r.shard for r in index.select("shard").distinct().collect()]  # no more than ids, or their repetitions
    shards = spark.read.parquet(f"{at}/shards").select("shard", "payload").where(F.col("shard").isin(of))
    frame = F.substring("payload", F.col("offset").cast("int") + 1, F.col("length"))
    return index.join(shards, "shard").select("doc_id", frame.alias("frame"), "dict_hash")


def decode(frame: bytes, dictionary: bytes, n_vocab: int) -> np.ndarray:
    """The ids of one frame."""
    shared = _dictionary(bytes(dictionary))
    press = zstandard.ZstdDecompressor(dict_data=shared) if shared else zstandard.ZstdDecompressor()
    return np.frombuffer(press.decompress(bytes(frame)), "<u2" if n_vocab <= 1 << 16 else "<u4")
