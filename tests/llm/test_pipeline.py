import re

import corpus_pipeline as pipeline
from weft.llm import packing, pretokens
from tests.llm.test_jaccard import links_of

AT = "/root/testdata/sf0.001"


def test_stage_by_stage(spark):
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    found = pipeline.language_id(spark, docs, AT)
    assert found.columns == docs.columns
    told = {r.doc_id: r for r in found.collect()}
    assert len(told) >= 0.99 * len(rows) and all(told[i].text == rows[i].text for i in told)

    kept = pipeline.near_duplicates(spark, found, AT)
    label = {i: c for i, c, _ in links_of([(i, r.text) for i, r in told.items()])}
    one = {r.doc_id: r for r in kept.collect()}
    assert set(one) == {i for i in told if label[i] == i} and kept.columns == docs.columns

    clean = pipeline.secrets(spark, kept, AT)
    cut = {r.doc_id: r for r in clean.collect()}
    assert set(cut) == set(one) and not any(re.search("[0-9a-fA-F]{40}", r.text) for r in cut.values())
    assert all(r.text == one[i].text or "[SECRET]" in r.text and r.n_chars == len(r.text) for i, r in cut.items())

    packed = pipeline.sequences(spark, clean, AT).collect()
    encode, most = pretokens.encoding().encode_ordinary, max(packing.CAPACITIES)
    want = sorted((i, k, min(most, n - k * most)) for i, r in cut.items() for n in [len(encode(r.text)) + 1] for k in range(-(-n // most)))
    assert sorted((r.doc_id, r.piece, r.n_tokens) for r in packed) == want
    bins = {}
    for r in packed:
        bins.setdefault((r.bin, r.capacity), []).append((r.bin_offset, r.n_tokens))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, capacity), items in bins.items():
        items.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(items, items[1:])) and sum(items[-1]) <= capacity


def test_run_and_empty(spark, tmp_path):
    docs = spark.createDataFrame([(1, "The and attion to thanedble the, anea.", "en", "s", 38), (2, None, None, None, None), (None, "Erinst resh of the and", "en", "s", 22), (3, "", "en", "s", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert {r.doc_id for r in pipeline.run(spark, f"{tmp_path}/a").collect()} == {1, None}
    assert pipeline.run(spark, f"{tmp_path}/b").count() == 0
