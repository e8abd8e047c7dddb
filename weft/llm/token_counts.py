"""Token counts: pieces are counted once per distinct pre-token of the corpus and joined to every document's pre-token
frequencies; ids are never made.

One pass over the texts turns each Arrow batch (a chunk) into a list of its distinct pre-tokens and, for every document, the
sparse frequencies over that list. The lists are shuffled by a hash of the pre-token, in packed rows, so that a pre-token
meets itself from all chunks in one partition, is counted there, and only its count goes back to the chunks that asked. The
texts themselves are never shuffled; what is, grows with the distinct pre-tokens of the chunks.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import pretokens
from weft.llm.common import buckets, pack, rows, texts, unpack, written

DOCS = -1
PACKED = pa.schema([("part", pa.int64()), ("bucket", pa.int32()), ("body", pa.binary())])


def _local(n_buckets: int):
    def chunks(batches):
        task = TaskContext.get().partitionId()
        for k, batch in enumerate(batches):
            vocabulary: dict[str, int] = {}
            number = lambda w: vocabulary.setdefault(w, len(vocabulary))
            spaced = pretokens.Memo(lambda u: tuple(map(number, pretokens.SPLIT.findall(" " + u))))
            idx, freq, each = [], [], []
            for text in batch["text"]:
                rest, whole = pretokens.parts(text.as_py() or "")
                own = Counter(map(number, whole))
                for unit, n in Counter(rest).items():
                    for w in spaced[unit]:
                        own[w] += n
                order = np.sort((np.fromiter(own, np.int64, len(own)) << 32) | np.fromiter(own.values(), np.int64, len(own)))
                words = order >> 32
                idx.append(np.diff(words, prepend=0).astype(np.uint32))
                freq.append((order & 0xFFFFFFFF).astype(np.uint32))
                each.append(len(own))
            known = np.array([x.is_valid for x in batch["doc_id"]], bool)
            body = pack(batch["doc_id"].fill_null(0).to_numpy().tobytes(), known.tobytes(), np.array(each, np.uint32).tobytes(), *(np.concatenate([*x, np.empty(0, np.uint32)]).tobytes() for x in (idx, freq)))
            part, out = task << 32 | k, []
            out.append((part, DOCS, body))
            by: dict[int, list[int]] = {}
            words = [w.encode("utf-8", "surrogatepass") for w in vocabulary]
            for i, w in enumerate(words):
                by.setdefault(zlib.crc32(w) % n_buckets, []).append(i)
            for b, own in by.items():
                out.append((part, b, pack(np.array(own, np.uint32).tobytes(), np.array([len(words[i]) for i in own], np.uint32).tobytes(), b"".join(words[i] for i in own))))
            yield rows(out, PACKED)

    return chunks


def _count(path: str):
    def counted(batches):
        encode, seen = pretokens.encoding(path).encode_ordinary, {}
        for batch in batches:
            out = []
            for part, body in zip(batch["part"].to_pylist(), batch["body"]):
                idx, lens, joined = unpack(body.as_buffer())
                ends = np.cumsum(np.frombuffer(lens, np.uint32), dtype=np.int64)
                joined, n, start = bytes(joined), np.empty(len(ends), np.uint32), 0
                for i, end in enumerate(ends.tolist()):
                    w = joined[start:end]
                    if (c := seen.get(w)) is None:
                        c = seen[w] = len(encode(w.decode("utf-8", "surrogatepass")))
                    n[i], start = c, end
                out.append((part, 0, pack(bytes(idx), n.tobytes())))
            yield rows(out, PACKED)

    return counted


RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_pretokens", pa.int64())])


def _sum(docs: pa.Table, counts: pa.Table) -> pa.Table:
    got = [[np.frombuffer(x, np.uint32) for x in unpack(b.as_buffer())] for b in counts["body"]]
    pieces = np.zeros(1 + max([0, *(int(i.max(initial=0)) for i, _ in got)]), np.int64)
    for i, n in got:
        pieces[i] = n
    out = []
    for body in docs["body"]:
        ids, known, each, idx, freq = unpack(body.as_buffer())
        ids, each = np.frombuffer(ids, np.int64), np.frombuffer(each, np.uint32).astype(np.int64)
        freq, ends = np.frombuffer(freq, np.uint32).astype(np.int64), np.cumsum(each)
        # indices are differences within a document: undone by a running sum less its value where the document begins
        run = np.cumsum(np.frombuffer(idx, np.uint32), dtype=np.int64)
        run -= np.repeat(np.concatenate([[0], run])[ends - each], each)
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])])
        out.append(pa.table([pa.array(ids, mask=~np.frombuffer(known, bool)), total(pieces[run] * freq), total(freq)], schema=RESULT))
    return pa.concat_tables(out) if out else RESULT.empty_table()


def token_counts(docs: DataFrame, vocabulary: str = pretokens.BPE_FILE) -> DataFrame:
    """(doc_id, n_tokens, n_pretokens) for every row of docs: tokens of the byte-level BPE `vocabulary`, a file of ranks.

    Null and empty texts have 0 of both. A repeated row gives a row each time, a null doc_id stays null. An empty table gives
    an empty one. Columns other than doc_id and text aren't read.
    """
    n = buckets(docs)
    local = written(texts(docs).mapInArrow(_local(n), "part bigint, bucket int, body binary"), "pretokens")
    counts = local.where(F.col("bucket") != DOCS).repartition(n, "bucket").mapInArrow(_count(vocabulary), local.schema)
    own = local.where(F.col("bucket") == DOCS)
    return own.groupBy("part").cogroup(counts.groupBy("part")).applyInArrow(_sum, "doc_id bigint, n_tokens bigint, n_pretokens bigint")
