import zlib

import numpy as np
import pyarrow as pa

from tests.conftest import DATA
from tests.llm.data import corpus, frame
from tessera.llm import quality
from tessera.llm.common import utf8


def test_held_out(spark):
    docs, labels = (spark.read.parquet(str(DATA / f"sf0.01/{t}.parquet")) for t in ("documents", "labels"))
    found = quality.classify(docs, labels)
    assert found.count() == docs.count() and found.filter("score < 0 OR score > 1 OR predicted <> CAST(score >= 0.7 AS INT)").count() == 0
    rows = found.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    out = [r for r in rows if r.held_out]
    assert len(out) > 50 and np.mean([r.predicted == r.quality for r in out]) >= 0.95
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns and kept.count() == found.filter("predicted = 1").count()


def test_never_learns_held_out(spark):
    """Labels of held-out rows, and columns other than the text, change no score."""
    docs, labels = frame(spark, corpus(), False), [(i, int(len(t or "") % 2)) for i, t in corpus()]
    schema = "doc_id long, quality int"
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    a = quality.classify(docs, spark.createDataFrame(labels, schema))
    b = quality.classify(docs.drop("lang", "source"), spark.createDataFrame([(i, 1 - q if held(i) else q) for i, q in labels], schema))
    assert {r.doc_id: r.score for r in a.collect()} == {r.doc_id: r.score for r in b.collect()}


def test_edges(spark):
    docs = frame(spark, corpus())
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 7), (4, 0), (5, 1), (6, 0)], "doc_id long, quality int")
    assert quality.classify(docs, labels).count() == docs.count()
    none = quality.classify(docs, labels.limit(0)).collect()
    assert len(none) == docs.count() and {round(r.score, 6) for r in none} == {0.5}
    assert quality.classify(docs.limit(0), labels).collect() == []
    assert all(r.held_out is False for r in quality.classify(docs, labels).filter("doc_id IS NULL").collect())


def test_features_do_not_depend_on_neighbours():
    texts = [t or "" for _, t in corpus()]
    together = quality.features(*utf8(pa.array(texts)))
    alone = np.concatenate([quality.features(*utf8(pa.array([t]))) for t in texts])
    assert np.allclose(together, alone) and np.isfinite(together).all()


def test_interaction():
    """Pairs are learnt: an exclusive or of two features, which no sum of single tables can tell."""
    rng = np.random.default_rng(1)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 5] > 0.5)).astype(float)
    model = quality.Gam(x, y)
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.9 and {(i, j) for i, j, _ in model.pairs} & {(5, 2)}


def _loss_of(g, h, cells):
    """What leaves with these cells explain of a gradient."""
    return sum(g[c].sum() ** 2 / (h[c].sum() + quality.RIDGE) for c in cells)


def test_splits_by_brute_force():
    """Trees and quarters are the best that trying every cut finds."""
    rng = np.random.default_rng(7)
    for _ in range(20):
        n = int(rng.integers(2, 9))
        g, h = rng.normal(size=n), rng.random(n) + 0.1
        step = quality.Gam._tree(g, h)
        first = max(range(1, n), key=lambda k: _loss_of(g, h, [slice(0, k), slice(k, n)]))
        tried = [sorted({0, first, k, n}) for k in range(1, n)]
        whole, one = _loss_of(g, h, [slice(0, n)]), _loss_of(g, h, [slice(0, first), slice(first, n)])
        best = max(_loss_of(g, h, [slice(a, b) for a, b in zip(t, t[1:])]) for t in tried) if one > whole + 1e-9 else whole
        edges = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), n]
        assert len(edges) <= 4 and np.isclose(_loss_of(g, h, [slice(a, b) for a, b in zip(edges, edges[1:])]), best)
        for a, b in zip(edges, edges[1:]):
            assert np.allclose(step[a:b], quality.STEP * g[a:b].sum() / (h[a:b].sum() + quality.RIDGE))
        g, h = rng.normal(size=(n, 5)), rng.random((n, 5)) + 0.1
        gain, grid = quality.Gam._quarters(g, h)
        cuts = [[(a, b) for a in (slice(0, r), slice(r, n)) for b in (slice(0, c), slice(c, 5))] for r in range(1, n) for c in range(1, 5)]
        assert np.isclose(gain, max(_loss_of(g, h, c) for c in cuts)) and len(np.unique(grid)) <= 4


def test_score_by_table_lookups():
    """Scores are the sums of single lookups."""
    rng = np.random.default_rng(8)
    x = rng.random((300, len(quality.FEATURES)))
    model = quality.Gam(x, (x[:, 1] + x[:, 3] > 1).astype(float))
    for row, score in zip(x, model.score(x)):
        at = [int((e <= v).sum()) for e, v in zip(model.edges, row)]
        logit = model.base + sum(t[i] for t, i in zip(model.tables, at)) + sum(t[at[i], at[j]] for i, j, t in model.pairs)
        assert np.isclose(score, 1 / (1 + np.exp(-logit)))
