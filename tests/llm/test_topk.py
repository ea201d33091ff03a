import math

import numpy as np
import pytest

from tests.conftest import DATA
from tessera.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, v string, rank int"


def brute(rows, every, k):
    good = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % every == 0:
            scored = sorted(((-sum(a * b for a, b in zip(q, c)), j) for j, c in good if j != i))[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(scored, 1)]
    return sorted(out)


def got(spark, rows, every, k):
    df = spark.createDataFrame([(i, v, 1, "v", 2) for i, v in rows], SCHEMA)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, every, k).collect())


@pytest.mark.parametrize("block, shard, page, salted", [(256, 4096, 256, 4096), (7, 40, 3, 2)])
def test_brute_force(spark, monkeypatch, block, shard, page, salted):
    for name, value in (("BLOCK", block), ("SHARD", shard), ("PAGE", page), ("SALTED", salted)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 6) / 64]) for i in rng.permutation(300)]  # many ties
    rows += [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (None, [1.0] * 6), (1020, [0.5, -0.25]), (1040, []), (1041, [-0.01] * 9)]
    assert got(spark, rows, 20, 20) == brute(rows, 20, 20)


def test_few_and_large(spark):
    assert got(spark, [(0, [1.0]), (1, [2.0])], 20, 20) == [(0, 1, 1, 64 * 128)]
    rows = [(i, [5e5 * (i + 1), -1e5]) for i in range(0, 60, 10)]
    assert got(spark, rows, 20, 3) == brute(rows, 20, 3)
    assert got(spark, [], 20, 3) == []


def test_repeated_rows(spark):
    assert got(spark, [(0, [1.0]), (5, [1.0]), (5, [1.0])], 20, 20) == [(0, 1, 5, 4096), (0, 2, 5, 4096)]


def test_pruning():
    """Blocks whose bound is below the k-th score are not scored."""
    rng = np.random.default_rng(2)
    x = np.sort(rng.integers(0, 100, (4096, 1)).astype(float), axis=0)[::-1]
    seen = []
    at, who, scores = topk.block_search(np.array([-1]), np.array([[1.0]]), np.array([-np.inf]), np.arange(4096), x, 5, seen)
    assert list(scores) == list(x[:5, 0])
    ties = sum((x[lo : lo + topk.BLOCK] >= x[4, 0]).any() for lo in range(0, 4096, topk.BLOCK))
    assert [b for b, _ in seen] == list(range(ties)) and ties < 4


def test_shards_out_of_reach_get_no_queries():
    """Only the shards whose bounds reach a query's k-th score are sent that query, and none that could matter is left out."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-200, 200, (12, 6)).astype(float)
    shards = [c + rng.integers(-3, 4, (100, 6)) for c in centres]
    q = shards[0][:10]
    scores = np.stack([q @ s.T for s in shards])
    least = np.sort(scores.transpose(1, 0, 2).reshape(10, -1), axis=1)[:, -20]
    high, low = np.stack([s.max(axis=0) for s in shards]), np.stack([s.min(axis=0) for s in shards])
    live = topk.reaching(q, least, high, low)
    needed = (scores >= least[None, :, None]).any(axis=2).T
    assert (live | ~needed).all() and live.sum() < live.size / 2


def test_matrices_come_back():
    for m in (np.zeros((0, 3)), np.array([[1.0, -2.0]]), np.array([[2.0**40, -1.0], [0.0, 5.0]]), np.zeros((2, 0))):
        back = topk.load(topk.dump(m))
        assert back.shape[1] == m.shape[1] and (back == m).all()


def test_same_as_table(spark):
    df = spark.read.parquet(str(DATA / "sf0.001/embeddings.parquet"))
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, 20, 20).collect()) == brute(rows, 20, 20)
