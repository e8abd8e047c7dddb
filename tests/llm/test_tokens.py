import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from weft.llm import packing, piece_rounds, pretokens, token_counts, token_store

TEXTS = [None, "", " ", "a", "a  b\n\n c ", "don't  stop", "x" * 5000, "äöü ß " * 3000, "\x00\x1c 　́🙂 日本語 12 ²Ⅷ", "same", "same"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", i) for i, t in enumerate(TEXTS)] + [(3, "a", None, 0), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, bucket string, n bigint").repartition(3)


@given(st.text(alphabet=" \t\n\r\x1c\x85　'sabtré12²Ⅷß!?_́🙂あ", max_size=60))
@settings(max_examples=400, deadline=None)
def test_units_hold_the_tokens(text):
    encoding = pretokens.encoding()
    assert pretokens.Counts()(text) == len(encoding.encode_ordinary(text))
    assert np.frombuffer(token_store.Ids(pretokens.BPE_FILE)(text), np.uint16).tolist() == encoding.encode_ordinary(text)


def test_token_counts(docs):
    encoding = pretokens.encoding()
    got = sorted(((r.doc_id, r.n_tokens, r.n_pretokens) for r in token_counts.token_counts(docs).collect()), key=str)
    want = sorted(((r.doc_id, len(encoding.encode_ordinary(r.text or "")), len(pretokens.SPLIT.findall(r.text or ""))) for r in docs.collect()), key=str)
    assert got == want
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def test_token_store_round_trip(docs, spark, tmp_path):
    encoding = pretokens.encoding()
    dictionary = token_store.train_dictionary(docs, size=4096)
    rows = token_store.frames(docs, dictionary).collect()
    by = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == docs.count() and {r.dict_hash for r in rows} == {token_store.digest(dictionary)}
    for r in rows:
        ids = token_store.decode(r.frame, dictionary, encoding.n_vocab).tolist()
        assert ids == encoding.encode_ordinary(by[r.doc_id] or "") and r.n_tokens == len(ids)
    at = f"file://{tmp_path}/store"
    token_store.write_store(docs, at)
    kept = {r.dict_hash: r.dictionary for r in spark.read.parquet(f"{at}/dictionaries").collect()}
    some = token_store.read_store(spark, at, [4, 7, 8]).collect()
    assert sorted(r.doc_id for r in some) == [4, 7, 8]
    for r in some:
        assert encoding.decode(token_store.decode(r.frame, kept[r.dict_hash], encoding.n_vocab).tolist()) == by[r.doc_id]
    assert token_store.token_store(docs.limit(0)).count() == 0
    whole = token_store.token_store(docs).collect()
    (own,) = [r for r in whole if r.shard is None]
    assert len(whole) == docs.count() + 1 and own.dict_hash == token_store.digest(own.frame)
    for r in whole:
        if r.shard is not None and r.doc_id in by:
            assert encoding.decode(token_store.decode(r.frame, own.frame, encoding.n_vocab).tolist()) == (by[r.doc_id] or "")
    twice, again = docs.unionByName(docs), str(tmp_path / "again")
    token_store.write_store(twice.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("bigint"))), again)
    assert spark.read.parquet(f"{again}/index").count() == 2 * docs.count() + 1 and token_store.read_store(spark, again, [4, -5]).count() == 2
    token_store.write_store(docs.limit(0), str(tmp_path / "none"))
    assert spark.read.parquet(str(tmp_path / "none" / "index")).count() == 0


def test_dictionary_helps(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    total = lambda d: sum(r.length for r in token_store.frames(docs, d).select("length").collect())
    assert total(token_store.train_dictionary(docs)) < total(b"")


@given(st.text(alphabet=" \n\tabcdeing1é日🙂▁", max_size=80))
@settings(max_examples=400, deadline=None)
def test_piece_rounds_match_the_library(text):
    library, own = sentencepiece.SentencePieceProcessor(model_file=piece_rounds.MODEL), piece_rounds.pieces()
    (ids,) = own.encode([text])
    assert ids.tolist() == library.encode(text)
    assert own.decode(ids.tolist()) == library.decode(ids.tolist())


def test_piece_rounds_over_a_table(docs):
    library = sentencepiece.SentencePieceProcessor(model_file=piece_rounds.MODEL)
    encoded = piece_rounds.encode(docs)
    got = sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=str)
    assert got == sorted(((r.doc_id, library.encode(r.text or "")) for r in docs.collect()), key=str)
    back = sorted(((r.doc_id, r.text) for r in piece_rounds.decode(encoded).collect()), key=str)
    assert back == sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=str)
    assert piece_rounds.encode(docs.limit(0)).count() == 0


def _one_by_one(lengths, capacities, overhead):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [(size - filled, i) for i, (size, filled) in enumerate(bins) if size - filled >= n]
        if fit:
            i = min(fit)[1]
            bins[i] = (bins[i][0], bins[i][1] + n)
        else:
            bins.append((packing.open_size(n, capacities, overhead), n))
    return sorted((filled, min(c for c in capacities if c >= filled)) for _, filled in bins)


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), max_size=20), st.sets(st.integers(1, 60), max_size=3))
@settings(max_examples=200, deadline=None)
def test_plan_is_best_fit_decreasing(counts, capacities):
    capacities = tuple(sorted(capacities | {60}))
    placements, bins = packing.plan(counts, capacities, 3)
    got = sorted((filled, c) for _, m, filled, c in bins for _ in range(m))
    assert got == _one_by_one([n for n, k in counts.items() for _ in range(k)], capacities, 3)


def test_packing_rows(spark):
    rng = random.Random(1)
    sizes = [(i, rng.choice([1, 5, 30, 64, 100, 7, 33])) for i in range(500)] + [(7, 5), (None, 9), (900, None), (901, 0)]
    got = packing.pack_lengths(spark.createDataFrame(sizes, "doc_id bigint, n bigint"), (16, 32, 64), 2).collect()
    bins = {}
    for r in got:
        bins.setdefault((r.bin, r.capacity), []).append((r.bin_offset, r.n_tokens))
    for (_, capacity), items in bins.items():
        items.sort()
        assert items[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(items, items[1:])) and capacity / 2 < max(sum(items[-1]), 8.5) <= capacity
    pieces = [min(64, n - s) for _, n in sizes if n for s in range(0, n, 64)]
    assert sorted(r.n_tokens for r in got) == sorted(pieces)
    assert sorted((sum(n for _, n in v), c) for (_, c), v in bins.items()) == _one_by_one(pieces, (16, 32, 64), 2)
    assert packing.pack_lengths(spark.createDataFrame([], "doc_id bigint, n bigint")).count() == 0
    assert packing.best_fit_packing(spark.createDataFrame([(1, None, 2), (2, "", 2)], "doc_id bigint, text string, n int")).count() == 2
