from collections import defaultdict

import numpy as np

from tests.conftest import DATA
from tests.llm.data import corpus, frame
from tessera.llm import mixing


def targets(sizes):
    """The stated rule, step by step: sources by code point, null last."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), {s for s in names if sizes[s]}, dict.fromkeys(names, 0.0)
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: share * weight[s] for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def check(rows):
    """rows: doc_id, source, size, source_size, target, taken."""
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken % max(1, r.size) == 0 and 0 <= r.taken <= 2 * r.size
    wanted = targets(dict(sizes))
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - wanted[r.source]) <= 1e-6 * max(1, r.target)
    return {s: (taken[s], wanted[s]) for s in sizes}


def mixed(spark, df):
    out = mixing.mix(df)
    names = {r.doc_id: r.source for r in df.select("doc_id", "source").distinct().collect()}

    class Row:
        def __init__(self, r):
            self.__dict__.update(r.asDict(), source=names[r.doc_id])

    return [Row(r) for r in out.collect()]


def test_tables(spark):
    df = spark.read.parquet(str(DATA / "sf0.01/documents.parquet"))
    rows = mixed(spark, df)
    assert len(rows) == df.count()
    for taken, target in check(rows).values():
        assert abs(taken - target) <= 0.01 * target
    again = {r.doc_id: r.taken for r in mixed(spark, df.repartition(5))}
    assert again == {r.doc_id: r.taken for r in rows}


def test_edges(spark):
    rows = mixed(spark, frame(spark, corpus()))
    assert len(rows) == len(corpus()) + 3
    check(rows)
    assert mixing.mix(frame(spark, corpus()).limit(0)).collect() == []
    blank = mixing.mix(frame(spark, [(1, ""), (2, None)], False)).collect()
    assert [(r.size, r.target, r.taken) for r in blank] == [(0, 0.0, 0)] * 2


def test_multipliers(spark):
    """Newton's multipliers solve the dual that bisection solves."""
    rng = np.random.default_rng(2)
    size = {s: rng.integers(1, 400, 60) for s in "=a =b =c".split()}
    hist = spark.createDataFrame([(s, int(v), int((x == v).sum())) for s, x in size.items() for v in np.unique(x)], "s string, size long, n long")
    goals = spark.createDataFrame([(s, int(x.sum()), float(x.sum() * f), float(x.mean())) for (s, x), f in zip(size.items(), (0.3, 1.7, 2.0))], "s string, source_size long, target double, mean double")
    found = {r.s: r.lam for r in mixing.balance(hist, goals).collect()}
    for (s, x), f in list(zip(size.items(), (0.3, 1.7, 2.0)))[:2]:
        lo, hi = -50.0, 50.0
        for _ in range(200):
            mid = (lo + hi) / 2
            total = (x * np.minimum(2, np.exp(np.minimum(mid * x / x.mean(), 10)))).sum()
            lo, hi = (mid, hi) if total < f * x.sum() else (lo, mid)
        assert abs(found[s] - lo) < 1e-6
    assert found["=c"] > 1e6


def test_take(spark):
    df = frame(spark, corpus(), False)
    copies = {r.doc_id: r.copies for r in mixing.mix(df).collect()}
    kept = defaultdict(int)
    for r in mixing.take(df).collect():
        assert r.d == "d" and len(r) == len(df.columns)
        kept[r.doc_id] += 1
    assert dict(kept) == {i: n for i, n in copies.items() if n}
