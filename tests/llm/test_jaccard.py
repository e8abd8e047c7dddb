import random
import tracemalloc

import duckdb
import numpy as np
import pytest

from weft.llm import jaccard_join as J


def brute(sets, least):
    return [(i, j, len(a & b), len(a | b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len(a & b) >= np.ceil(len(a | b) * least - 1e-9)]


@pytest.mark.parametrize("seed", range(12))
def test_cells_are_exact(seed, monkeypatch):
    monkeypatch.setattr(J, "LEAF", 8)
    rng, sets = random.Random(seed), []
    for _ in range(rng.randrange(1, 8)):
        base = [rng.randrange(10**6) for _ in range(rng.randrange(1, 60))]
        for _ in range(rng.randrange(1, 25)):
            sets.append({x if rng.random() > 0.08 else rng.randrange(10**6) for x in base} | set(rng.sample(range(30), rng.randrange(5))))
    least = rng.choice([0.3, 0.6, 0.8])
    assert J.join_sets([np.array(sorted(s), np.uint64) for s in sets], least) == brute(sets, least)


def grams(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + J.N]) for i in range(max(1, len(w) - J.N + 1))} if w else set()


def links_of(rows, least=J.LEAST):
    """(doc_id, class_id, links) by comparing every text with every other."""
    items = sorted({(a, frozenset(grams(x))) for a, x in rows if a is not None}, key=lambda x: x[0])
    label, links = {a: a for a, _ in items}, {a: 0 for a, _ in items}
    linked = [(a, b) for i, (a, s) in enumerate(items) for b, t in items[i + 1 :] if s and t and len(s & t) >= np.ceil(len(s | t) * least - 1e-9)]
    for a, b in linked:
        links[a] += 1
        links[b] += 1
    for _ in range(len(label)):
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
    return sorted((a, label[a], n) for a, n in links.items())


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6)))
    passage = [word() for _ in range(50)]
    rows = [(i, t) for i, t in enumerate([None, "", " \n ", "one", "One ", "two words", "two  WORDS", "a b c", "x" * 20000])]
    for g in range(6):
        base = [word() for _ in range(rng.choice([8, 40, 200]))]
        for _ in range(rng.choice([1, 2, 15])):
            rows.append((len(rows), " ".join(w if rng.random() > 0.03 else word() for w in base)))
    for _ in range(12):
        rows.append((len(rows), " ".join([word() for _ in range(60)] + passage)))
    rows += [rows[-1], (None, rows[-1][1]), (12, "another text of a repeated id"), (12, rows[11][1]), (len(rows) + 5, rows[20][1])]
    return rows, spark.createDataFrame([(a, b, "x", 1, 2) for a, b in rows], "doc_id bigint, text string, p string, n int, links int").repartition(4)


def test_links_against_brute_force(corpus, monkeypatch):
    rows, docs = corpus
    got = sorted(tuple(r) for r in J.jaccard_links(docs).collect())
    assert got == links_of(rows) and sum(n for _, _, n in got) > 100
    monkeypatch.setattr(J, "REGION", 5)  # regions joined block by block
    assert sorted(tuple(r) for r in J.jaccard_links(docs).collect()) == got
    monkeypatch.setattr(J, "BROADCAST", 0)  # texts shuffled to the lists of ids
    monkeypatch.setattr(J, "STRONG", 1000)  # a region for each pivot
    assert sorted(tuple(r) for r in J.jaccard_links(docs).collect()) == got
    assert J.jaccard_links(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_links_of_clusters_that_overlap(spark, seed):
    rng, rows = random.Random(seed), []
    for _ in range(5):
        at = [rng.randrange(3000) for _ in range(rng.choice([6, 30, 90]))]
        for _ in range(30):
            k = rng.randrange(len(at))
            at = [*at[:k], rng.randrange(3000), *at[k + 1 :]]  # a chain: the first and the last are no partners
            rows.append((rng.randrange(200), " ".join(map(str, at))))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted(tuple(r) for r in J.jaccard_links(docs).collect()) == links_of(rows)


def test_one_of_each_group_stays(corpus):
    rows, docs = corpus
    label = {a: c for a, c, _ in links_of(rows)}
    kept = J.keep_one(docs).collect()
    want = {(a, b) for a, b in rows if a is None or label[a] == a}
    assert len(kept) == len(want) and {(r.doc_id, r.text) for r in kept} == want
    assert J.keep_one(docs).columns == docs.columns


def test_oracle(spark):
    at = "/root/testdata/sf0.001"
    duckdb.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{at}/documents.parquet'")
    want = sorted(duckdb.execute(J.ORACLE).fetchall())
    got = sorted(tuple(r) for r in J.jaccard_links(spark.read.parquet(f"{at}/documents.parquet")).collect())
    assert got == want and any(n for _, _, n in got)


def rows_written(monkeypatch):
    """Rows of each intermediate table, as they are written."""
    found, written = {}, J.written

    def count(df, name):
        found[name] = (out := written(df, name)).count()
        return out

    monkeypatch.setattr(J, "written", count)
    return found


def test_copies_meet_nothing(spark, monkeypatch):
    rng, rows = random.Random(5), []
    for k in range(60):
        text = " ".join(str(rng.randrange(400)) for _ in range(120))
        rows += [(100 * c + k, text) for c in range(12)]
        rows.append((5000 + k, text + " changed"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = rows_written(monkeypatch)
    assert sorted(tuple(r) for r in J.jaccard_links(docs).collect()) == links_of(rows)
    assert found["met"] < 400 and found["spread"] <= 120
    monkeypatch.setattr(J, "BROADCAST", 0)  # the texts that are left are written
    assert sorted(tuple(r) for r in J.jaccard_links(docs).collect()) == links_of(rows) and found["one"] == 120


def test_rare_first_beyond_the_known_frequencies(spark, monkeypatch):
    rng, rows = random.Random(6), []
    phrases = [[f"p{k}w{j}" for j in range(3)] for k in range(60)]
    for i in range(150):
        own = [w for k in rng.sample(range(60), 30) for w in phrases[k]]
        rows.append((i, " ".join(own + [f"d{i}w{j}" for j in range(150)])))
    rows.append((150, rows[7][1] + " changed"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    monkeypatch.setattr(J, "GRAMS", 3)  # as if all n-grams were those of a large corpus
    order = J.gram_order(docs, 32, 4, J.N)
    block = J.Block([" ".join(x) for x in phrases] + [f"d{i}w5 d{i}w6 d{i}w7" for i in range(150)])
    ranks = order.ranks(block.gram_hashes())
    assert (ranks[:60] > 0).all() and (ranks[60:] == 0).mean() > 0.8 and len(order.grams) <= 3
    found = rows_written(monkeypatch)
    assert sorted(tuple(r) for r in J.jaccard_links(docs).collect()) == links_of(rows)
    assert found["spread"] <= 4


def test_common_grams_of_no_pair_send_no_texts(spark, monkeypatch):
    rng, rows = random.Random(7), []
    phrases = [[f"p{k}w{j}" for j in range(6)] for k in range(1600)]
    for i in range(400):  # each phrase is in some twelve documents, and two documents share one or two
        rows.append((i, " ".join(w for k in rng.sample(range(1600), 50) for w in phrases[k])))
    rows += [(500 + i, rows[i][1] + " changed") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found, want = rows_written(monkeypatch), links_of(rows)
    assert sorted(tuple(r) for r in J.jaccard_links(docs).collect()) == want
    assert found["candidates"] > 2000 and found["spread"] <= 100
    monkeypatch.setattr(J, "MIDDLE", 12)  # some are left to pairs
    assert sorted(tuple(r) for r in J.jaccard_links(docs).collect()) == want


def test_tasks_are_bounded_by_grams_and_text(spark, monkeypatch):
    rng, rows = random.Random(8), []
    long, line = [str(rng.randrange(10**5)) for _ in range(1000)], [str(rng.randrange(10**5)) for _ in range(60)]
    for i in range(40):  # near copies of a long text, and texts of few n-grams that are as long
        k = rng.randrange(990)
        rows.append((i, " ".join([*long[:k], str(i), *long[k:]])))
        k = rng.randrange(58)
        rows.append((100 + i, " ".join([*line[:k], str(i), *line[k:]] * 16)))
    rows += [(200, " ".join(long[:700] * 20)), (0, rows[-1][1])]  # larger than a block; a repeated id
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    monkeypatch.setattr(J, "CELL", 10_000, raising=False)
    found, written = {}, J.written
    monkeypatch.setattr(J, "written", lambda df, name: found.update({name: written(df, name)}) or found[name])
    links = J.jaccard_links(docs)
    size = {i: max(len(grams(x)), len(x) // 8) for i, x in rows}
    tasks, blocks = {}, {}
    for r in written(links, "links") and found["spread"].collect():
        tasks.setdefault((r.p, r.i, r.j), []).append(size[r.x])
        blocks.setdefault(r.p, set()).add(r.block)
    assert max(sum(t) - 2 * max(t) for t in tasks.values()) <= 10_000 and max(map(len, blocks.values())) > 3
    assert all(b == set(range(len(b))) for b in blocks.values())  # none is empty
    assert sorted(tuple(r) for r in links.collect()) == links_of(rows)


@pytest.mark.parametrize("seed", range(6))
def test_pairs_of_two_sides(seed, monkeypatch):
    monkeypatch.setattr(J, "LEAF", 4)
    rng, sets = random.Random(seed), []
    for _ in range(5):
        base = [rng.randrange(10**6) for _ in range(rng.randrange(1, 60))]
        sets += [{x if rng.random() > 0.08 else rng.randrange(10**6) for x in base} for _ in range(rng.randrange(1, 40))]
    side, out = np.array([rng.random() < 0.4 for _ in sets]), []
    J._join(J.Cell([np.array(sorted(s), np.uint64) for s in sets]), np.arange(len(sets)), 0.6, lambda a, b, o, u: out.extend(zip(a.tolist(), b.tolist(), o.tolist(), u.tolist())), side=side)
    assert sorted((min(i, j), max(i, j), o, u) for i, j, o, u in out) == [x for x in brute(sets, 0.6) if side[x[0]] != side[x[1]]]


def test_memory_of_a_cell():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(3000) < 0.02, rng.integers(0, 1 << 63, 3000).astype(np.uint64), base)) for _ in range(400)]
    n = sum(map(len, sets))
    tracemalloc.start()
    cell = J.Cell(sets)
    cell.distances(np.arange(400), np.array([0]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak / n < 40


def test_each_task_has_a_bucket_of_its_own(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, " ".join(str(rng.randrange(10)) for _ in range(300))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found, written = {}, J.written
    monkeypatch.setattr(J, "written", lambda df, name: found.update({name: written(df, name)}) or found[name])
    monkeypatch.setattr(J, "buckets", lambda df: 16)
    J.jaccard_links(docs)
    for name in ("grams", "met"):
        assert len({r.f for r in found[name].select(J.F.input_file_name().alias("f")).collect()}) == 16, name
