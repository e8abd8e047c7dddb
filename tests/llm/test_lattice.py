import numpy as np

from weft.llm import lattice as L


def brute(rows, least=L.LEAST):
    """(links of each vec_id, groups) by comparing every vector with every other."""
    items = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)})
    links, label = {i: 0 for i, _ in rows if i is not None}, {i: i for i, _ in rows if i is not None}
    pairs = []
    for dim in {len(v) for _, v in items}:
        some = [(i, v) for i, v in items if len(v) == dim]
        x = np.array([v for _, v in some])
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        pairs += [(some[a][0], some[b][0]) for a, b in np.argwhere(np.triu(x @ x.T >= least - 1e-9, 1))]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    for _ in range(len(rows)):
        before = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    return links, label


def table(spark, rows):
    return spark.createDataFrame([(i, v, 3, 1) for i, v in rows], "vec_id bigint, embedding array<double>, id int, links int").repartition(3)


def test_nearest_point():
    y = np.random.default_rng(0).normal(size=(3000, 8)) * 3
    p = L.nearest(y)
    own = ((y - p) ** 2).sum(1)
    assert (own <= ((y[:, None] - p[:, None] - L.neighbours()) ** 2).sum(2).min(1) + 1e-9).all() and own.max() <= 1 + 1e-9
    assert ((2 * p) % 1 == 0).all() and (p.sum(1) % 2 == 0).all() and len(np.unique(L.neighbours(), axis=0)) == 240


def test_links_against_brute_force(spark):
    rng, rows = np.random.default_rng(1), []
    for c in range(120):
        x = rng.normal(size=32)
        for _ in range(rng.integers(1, 7)):
            rows.append((len(rows), (x + rng.normal(size=32) * rng.choice([0.02, 0.05])).tolist()))
    rows += [(len(rows) + 1, rows[0][1]), (len(rows) + 2, rows[0][1]), rows[5], (None, rows[0][1]), (9001, None), (9002, []), (9003, [0.0] * 32), (9004, [1.0, None]), (9005, [float("nan")] * 32), (9006, [1.0, 2.0]), (9007, [2.0, 4.0]), (9006, rows[1][1]), (9008, [1e200] * 3), (9009, [1e-200] * 3)]
    got = {r.vec_id: r for r in L.near_links(table(spark, rows)).collect()}
    links, label = brute(rows)
    assert got.keys() == links.keys() and all(r.links <= links[i] for i, r in got.items())
    assert sum(r.links for r in got.values()) >= 0.98 * sum(links.values()) > 500
    assert sum(got[i].class_id == label[i] for i in got) >= 0.98 * len(got) and got[9009].class_id == 9008 and got[9007].links == 1
    assert L.near_links(table(spark, rows).limit(0)).count() == 0


def test_recall_at_the_threshold(spark):
    for dim in (8, 16, 64, 200):
        rng, rows = np.random.default_rng(dim), []
        for c in np.linspace(0.951, 0.97, 400):
            x, y = np.linalg.qr(rng.normal(size=(dim, 2)))[0].T
            rows += [(len(rows), x.tolist()), (len(rows) + 1, (c * x + np.sqrt(1 - c * c) * y).tolist())]
        links, _ = brute(rows)
        got = sum(r.links for r in L.near_links(table(spark, rows)).collect())
        assert 0.9 * sum(links.values()) <= got <= sum(links.values()) and sum(links.values()) >= 800
