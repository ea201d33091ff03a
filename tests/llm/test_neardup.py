import random
from itertools import combinations

import numpy as np
import pytest

from tests.conftest import DATA
from tests.llm.data import corpus, frame, words
from tessera.llm import neardup


def shingles(text):
    w = (text or "").encode().split()
    return frozenset([b"\0".join(w)] if 0 < len(w) < 5 else [b"\0".join(w[i : i + 5]) for i in range(len(w) - 4)])


def brute(rows):
    """Rows (doc_id, class_id, copy_id, n_links) of distinct ids."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    links = [0] * len(rows)
    key = lambda i: -1 if rows[i][0] is None else rows[i][0]
    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            links[i] += 1
            links[j] += 1
            a, b = label[i], label[j]
            label = [a if x == b else x for x in label]
    out = []
    for i in range(len(rows)):
        own = [j for j in range(len(rows)) if label[j] == label[i]]
        same = [j for j in range(len(rows)) if rows[j][1] == rows[i][1]] if sets[i] else [i]
        low = lambda group: rows[min(group, key=key)][0]
        out.append((rows[i][0], low(own), low(same), links[i]))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.class_id, r.copy_id, r.n_links) for r in df.collect()), key=str)


def test_brute_force(spark):
    rows = corpus() + [(None, corpus()[5][1])]
    assert got(neardup.jaccard_join(frame(spark, rows, False))) == brute(rows)


@pytest.mark.parametrize("most", [64, 1])
def test_parts(spark, monkeypatch, most):
    """A component of many parts, compared whole or by its buckets, gives the same rows."""
    monkeypatch.setattr(neardup, "PART_CLASSES", 5)
    monkeypatch.setattr(neardup, "MOST_PARTS", most)
    rng = np.random.default_rng(3)
    import random

    base = words(random.Random(1), 150)
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(int(rng.integers(0, 5))):
            own[int(rng.integers(0, 150))] = f"q{rng.integers(0, 1000)}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, t) for i, t in corpus(5)]
    assert got(neardup.jaccard_join(frame(spark, rows, False))) == brute(rows)


def test_repeated_rows(spark):
    found = got(neardup.jaccard_join(frame(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "")], False)))
    assert found == [(1, 1, 1, 2), (1, 1, 1, 2), (2, 1, 1, 2), (3, 3, 3, 0)]
    neardup.jaccard_join(frame(spark, corpus())).collect()


def test_keep_one(spark):
    rows = corpus()
    kept = sorted(r.doc_id for r in neardup.keep_one(frame(spark, rows, False)).collect())
    assert kept == sorted({r[1] for r in brute(rows)})
    assert [r.doc_id for r in neardup.keep_one(frame(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], False)).collect()] == [1]


def test_no_id_is_no_class(spark):
    """Texts without an id, or of one id, are told apart: none is lost, none fuses what it is not near to."""
    rng = random.Random(11)
    a, b, c, d = (words(rng, 80) for _ in range(4))
    near = lambda w, k: " ".join([*w[:-k], *(f"n{i}" for i in range(k))])
    rows = [(None, " ".join(a)), (None, " ".join(b)), (None, " ".join(b)), (None, " ".join(c)), (5, near(a, 2)), (6, near(b, 3)), (7, " ".join(d)), (7, near(c, 4)), (7, "x y z"), (8, near(d, 1)), (None, ""), (9, "x y z")]
    expected = [(None, " ".join(a)), (None, " ".join(b)), (None, " ".join(c)), (7, " ".join(d)), (7, "x y z"), (None, "")]
    kept = neardup.keep_one(frame(spark, rows, False)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(expected, key=str)
    assert got(neardup.jaccard_join(frame(spark, rows, False))) == brute(rows)


def test_empty(spark):
    assert neardup.jaccard_join(frame(spark, corpus()).limit(0)).collect() == []


def test_hashes_of_patterned_words(spark):
    """Words that differ in every letter by a self-similar pattern have different hashes."""
    letters = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    other = letters.translate(str.maketrans("ab", "ba"))
    rows = [(1, letters), (2, other), (3, f"a b c {letters} d e f g"), (4, f"a b c {other} d e f g")]
    assert got(neardup.jaccard_join(frame(spark, rows, False))) == brute(rows)


def test_links_of_planted_pairs(spark):
    """All pairs of a similarity between 0.8 and 0.9 are found."""
    rng = random.Random(9)
    rows, due = [], 0
    for i in range(200):
        base = words(rng, 200, 100_000)
        near = list(base)
        for _ in range(rng.randrange(2, 5)):
            near[rng.randrange(200)] = f"q{rng.randrange(10**6)}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(near))]
        a, b = (shingles(t) for _, t in rows[-2:])
        due += 0.8 <= len(a & b) / len(a | b) <= 0.97
    assert due > 150
    assert got(neardup.jaccard_join(frame(spark, rows, False))) == brute(rows)


def test_recall():
    s = neardup.THRESHOLD
    assert 1 - (1 - s**neardup.ROWS) ** neardup.BANDS > 0.99997


@pytest.mark.parametrize("name", ["op1_jaccard_join", "op5_substring_dedup", "op6_chat_format", "op8_exact_topk"])
def test_same_as_sql(same_as_sql, name):
    same_as_sql(name, DATA / "sf0.001")
