import random
from collections import Counter

import corpus_pipeline as cp
from tests.conftest import DATA
from tests.llm.data import words
from tests.llm.test_neardup import brute as linked
from tests.llm.test_substring import brute as shortened
from tessera.llm import mixing, pieces, quality


def test_stages(spark, tmp_path):
    """Each stage against brute force on what its predecessor kept."""
    folder = str(DATA / "sf0.001")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    kept = [docs]
    for name, stage in cp.STAGES:
        out = stage(spark, kept[-1], folder)
        out.write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
    assert all(k.columns == list(cp.COLUMNS) for k in kept[1:-1])
    rows = [[(r.doc_id, r.text) for r in k.collect()] for k in kept[:-1]]
    good = {r.doc_id for r in quality.classify(docs, labels).filter("predicted = 1").collect()}
    assert sorted(rows[1]) == sorted(r for r in rows[0] if r[0] in good)
    assert {i for i, _ in rows[2]} == {c for _, c, _, _ in linked(rows[1])}
    assert {i: len(t.split()) for i, t in rows[3]} == {i: n - gone for i, n, gone, _ in shortened(rows[2])}
    copies = {r.doc_id: r.copies for r in mixing.mix(kept[3]).collect()}
    assert Counter(rows[4]) == Counter({r: copies[r[0]] for r in rows[3] if copies[r[0]]})
    found = Counter((r.doc_id, tuple(r.ids)) for r in kept[5].collect())
    assert found == Counter((r.doc_id, tuple(r.ids)) for r in pieces.encode_documents(kept[4]).collect()) and kept[5].filter("NOT parity").count() == 0


def test_run(spark):
    assert cp.run(spark, str(DATA / "sf0.001")).count() > 0 and cp.ORACLE_SQL is None and len(cp.STAGES) == 5


def _run(spark, folder, rows, labels):
    """All stages over rows (doc_id, text, source) with a clashing column; the rows that each stage keeps."""
    full = [(i, t, "en", s, None, "x", 1, "k") for i, t, s in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score string, copies int, k1 string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for n, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{n}")
        docs = spark.read.parquet(f"{folder}/stage{n}")
        kept.append(docs.collect())
    return kept


def test_hard_rows(spark, tmp_path):
    """Null and repeated ids, null and empty texts, ties and repeated rows: no document is lost or merged with another."""
    rng = random.Random(21)
    a, b, c, d, e = (" ".join(words(rng, 120, 10**6)) for _ in range(5))
    near = a.rsplit(" ", 2)[0] + " one two"
    rows = [(None, a, "s"), (None, b, "s"), (None, b, "s"), (4, c, None), (4, d, "t"), (4, d, "t"), (9, near, "t"), (9, e, None), (None, None, None), (11, "", "s"), (12, None, "u")]
    labels = [(i, 1, 0) for i in (4, 9, 11, 12, 20, 21)]
    kept = _run(spark, str(tmp_path), rows, labels * 40)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept[0]) == sorted((i is None, i or 0, t or "") for i, t, _ in rows)
    full = Counter((r.doc_id, r.text or "") for r in kept[1])
    assert full == Counter([(None, a), (None, b), (4, c), (4, d), (9, e), (None, ""), (11, ""), (12, "")])
    assert Counter((r.doc_id, r.text) for r in kept[2]) == full
    assert {(r.doc_id, r.text) for r in kept[3] if not r.text} == {(None, ""), (11, ""), (12, "")}
    assert len(kept[4]) == len(kept[3]) and all(r.round_trip and r.parity for r in kept[4])


def test_no_labels_and_no_rows(spark, tmp_path):
    kept = _run(spark, str(tmp_path / "a"), [(1, "a b c", "s"), (2, "", None)], [])
    assert [len(k) for k in kept] == [0] * 5
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "b/documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "b/labels.parquet"))
    assert cp.run(spark, str(tmp_path / "b")).collect() == []
