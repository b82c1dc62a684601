import numpy as np
import pytest

from rollcall.llm import neighbours as n


def clustered(count, seed, dim=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(count // 4, dim))
    x = centres[rng.integers(0, len(centres), count)] + rng.normal(scale=0.22, size=(count, dim))
    return (x * rng.uniform(0.2, 3, (count, 1))).astype(np.float32)


def brute(x, k, least):
    u = x.astype(float) / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 7)
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return {tuple(sorted((i, int(j)))) for i in range(len(x)) for j in top[i] if s[i, j] >= least}


def frame(spark, x, ids=None):
    return spark.createDataFrame([(str(i if ids is None else ids[i]), [float(v) for v in r], 0) for i, r in enumerate(x)], "id string, embedding array<float>, a int")


def found(df):
    return {tuple(sorted((int(r[0]), int(r[1])))) for r in df.collect()}


@pytest.mark.parametrize("shard", [8192, 150])
def test_recall(spark, shard):
    # 150: many cells, some of them split into shards that search each other.
    x = clustered(1500, shard)
    want, got = brute(x, 5, 0.9), found(n.similar_pairs(frame(spark, x), shard=shard))
    assert len(want) > 500 and len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.05 * len(want)


def proposed(x, least, searched):
    got = []
    graph = n.Graph(x)
    graph.build(lambda nodes, ids, sims: got.append(n.best_of(nodes, ids, sims, 10, least, len(x))), least, searched)
    return graph, n._top(*(np.concatenate([g[i] for g in got]) for i in range(3)), 5)


@pytest.mark.parametrize("least", [-1.0, 0.9])
def test_vectors_of_a_shard_are_all_compared(monkeypatch, least):
    # Without structure a beam search misses most neighbours; edges that nobody follows cost as much again.
    x = np.random.default_rng(3).normal(size=(5000, 64))
    x[2500:] = x[:2500] + np.random.default_rng(4).normal(scale=0.4, size=(2500, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    monkeypatch.setattr(n.Graph, "prune", lambda *a: pytest.fail("edges that nobody follows"))
    _, (a, b, s) = proposed(x, least, False)
    assert {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())} == brute(x, 5, least) and (s >= least).all()


@pytest.mark.parametrize("searched, edges", [(True, 900), (False, 600)])
def test_edges_are_made_where_they_are_followed(monkeypatch, searched, edges):
    monkeypatch.setattr(n, "BATCH", 300)
    x = clustered(900, 6)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, (a, b, _) = proposed(x, 0.9, searched)
    want = brute(x, 5, 0.9)
    assert (graph.used[:900] > 0).sum() == edges
    assert len({tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())} & want) >= 0.95 * len(want)


def test_hot_cell_is_split(spark, monkeypatch):
    monkeypatch.setattr(n, "CELLS", 1)
    monkeypatch.setattr(n, "FINE", 1)
    x = clustered(900, 5)
    want, got = brute(x, 5, 0.9), found(n.similar_pairs(frame(spark, x), shard=100))
    assert len(got & want) >= 0.95 * len(want)


def test_cells_of_two_levels(spark):
    x = clustered(1500, 4)
    got = found(n.similar_pairs(frame(spark, x), shard=100, most_cells=4))
    want = brute(x, 5, 0.9)
    assert len(got & want) >= 0.9 * len(want)


def test_many_cells_keep_pairs_together():
    # Vectors without structure and a variant of each: of pairs near a border, two cells a vector aren't enough to meet in.
    rng = np.random.default_rng(8)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    x = unit(rng.normal(size=(3000, 64)))
    y = unit(x + rng.normal(scale=0.038, size=x.shape))
    middle = n.centroids(unit(rng.normal(size=(20000, 64))), 1000)
    (a, near_a), (b, near_b) = n._cells(x, middle, None), n._cells(y, middle, None)
    met = ((a[:, :, None] == b[:, None, :]) & near_a[:, :, None] & near_b[:, None, :]).any((1, 2))
    assert 0.9 < (x * y).sum(1).mean() < 0.97 and met.mean() >= 0.985 and near_a.sum(1).mean() < 4


def test_vectors_travel_whole():
    x = np.round(np.random.default_rng(1).uniform(-1, 1, (50, 64)), 6).astype(np.float32)
    x[0, :3] = -1, 1, 0
    assert np.array_equal(n.unpacked(n.packed(x).tobytes(), 64), x)


def test_recall_without_a_floor(spark):
    x = clustered(1200, 3)
    got = {}
    for r in n.nearest(frame(spark, x), 5).collect():
        got.setdefault(int(r["a"]), []).append((r["rank"], int(r["b"])))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, axis=1)[:, :5]
    hits = sum(len({b for _, b in got[i]} & set(want[i].tolist())) for i in range(len(x)))
    assert all(sorted(r for r, _ in v) == [1, 2, 3, 4, 5] for v in got.values()) and hits >= 0.9 * 5 * len(x)


def test_invalid_vectors_and_empty(spark):
    v = [1.0] * 64
    rows = [("a", v), ("b", [2.0] * 64), ("c", None), ("d", [0.0] * 64), ("e", [1.0] * 32), ("f", [float("nan")] * 64), ("g", [float("inf")] + v[1:]), ("h", [None] + v[1:])]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    assert [tuple(r) for r in n.similar_pairs(df).collect()] == [("a", "b")]
    assert n.similar_pairs(df.filter("false")).count() == 0


def test_copies_keep_their_places(spark):
    x = clustered(60, 9)
    x = np.vstack([x, np.repeat(x[:1], 40, axis=0)])
    got = n.nearest(frame(spark, x), 5, 0.9).collect()
    per = {}
    for r in got:
        per.setdefault(int(r["a"]), []).append(int(r["b"]))
    same = {0, *range(60, 100)}
    assert all(len(per[i]) == 5 and set(per[i]) <= same for i in same)
    assert all(r["similarity"] >= 0.9 for r in got)
