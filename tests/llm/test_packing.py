import numpy as np
import pytest

from rollcall.llm import packing as p


@pytest.mark.parametrize("seed", range(4))
def test_pack_holds_and_fills(seed):
    rng = np.random.default_rng(seed)
    sizes = np.minimum(rng.lognormal(4.5, 0.9, 2000).astype(int), 512)
    at = p.pack(sizes, 512)
    load = np.bincount(at, sizes)
    assert (at >= 0).all() and load.max() <= 512 and sizes.sum() / (len(load) * 512) > 0.97


def test_ties_zeros_and_one():
    assert p.pack(np.zeros(5, int), 10).max() == 0 and len(p.pack(np.zeros(0, int), 10)) == 0
    assert sorted(np.bincount(p.pack(np.full(6, 5), 10))) == [2, 2, 2]


def test_containers(spark):
    docs = spark.createDataFrame([(1, "word " * 300, 1), (2, None, 1), (3, "", 1), (4, "a b c", 1), (5, "a b c", 1)], "doc_id long, text string, part int")
    sizes = spark.createDataFrame([(1, 128), (1, 128), (2, 0), (3, None), (4, 100000)], "size_id int, capacity_tokens int")
    rows = p.fill_containers(docs, sizes).collect()
    by = {}
    for r in rows:
        by.setdefault((r["size_id"], r["doc_id"]), []).append((r["start_token"], r["n_tokens"]))
    assert {k[0] for k in by} == {1, 4} and len(by) == 10
    parts = sorted(by[(1, 1)])
    assert len(parts) > 1 and all(n == 128 for _, n in parts[:-1]) and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
    assert len(by[(4, 1)]) == 1 and by[(4, 2)] == [(0, 0)]
    load = {}
    for r in rows:
        load[r["size_id"], r["container_id"]] = load.get((r["size_id"], r["container_id"]), 0) + r["n_tokens"]
    assert all(v <= (128 if k[0] == 1 else 100000) for k, v in load.items())
    report = {r["size_id"]: r for r in p.fill_report(p.fill_containers(docs, sizes), sizes).collect()}
    assert report[4]["containers"] == 1 and report[1]["filled"] <= 1
    assert p.fill_containers(docs.filter("false"), sizes).count() == 0
