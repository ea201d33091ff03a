import hashlib
import random

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from tests.llm.data import corpus, frame, words
from tessera.llm import substring
from tessera.llm.common import Words


def brute(rows):
    first, out = {}, []
    texts = {i: (t or "").encode().split() for i, t in rows}
    for i in sorted(texts):
        for p in range(len(texts[i]) - 19):
            first.setdefault(tuple(texts[i][p : p + 20]), (i, p))
    for i, w in texts.items():
        gone = set()
        for p in range(len(w) - 19):
            if first[tuple(w[p : p + 20])] < (i, p):
                gone.update(range(p, p + 20))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect())


def test_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert got(substring.dedup(frame(spark, rows, False))) == brute(rows)


def test_repeated_rows(spark):
    """Rows of one id and text fare alike, and neither takes words from the other; a null id comes first."""
    text = " ".join(f"u{i}" for i in range(40))
    found = substring.dedup(frame(spark, [(5, text), (5, text), (9, text)], False)).select("doc_id", "n_removed").collect()
    assert sorted(map(tuple, found)) == [(5, 0), (5, 0), (9, 40)]
    found = substring.dedup(frame(spark, [(None, text), (5, text), (5, "other " + text)], False)).select("doc_id", "n_removed").collect()
    assert sorted(map(tuple, found), key=str) == [(5, 40), (5, 40), (None, 0)]


def test_rows_of_one_id(spark):
    """Different texts of one id, or of none, are documents of their own; plain texts of them lose nothing."""
    rng = random.Random(3)
    rows = [(None, " ".join(words(rng, 60, 10**6))) for _ in range(40)] + [(7, " ".join(words(rng, 60, 10**6))) for _ in range(40)]
    found = substring.dedup(frame(spark, rows, False)).collect()
    assert len(found) == 80 and all((r.n_words, r.n_removed) == (60, 0) for r in found)
    shared = " ".join(words(rng, 30, 10**6))
    rows += [(7, f"x{i} {shared}") for i in range(3)] + [(None, f"y {shared}")]
    found = substring.dedup(frame(spark, rows, False)).collect()
    assert sorted(r.n_removed for r in found if r.n_words == 31) == [0, 30, 30, 30] and sum(r.n_removed for r in found) == 90


def test_patterned_words(spark):
    """Different words of a self-similar pattern are not taken for each other."""
    letters = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    other = letters.translate(str.maketrans("ab", "ba"))
    around = [f"w{i}" for i in range(30)]
    rows = [(1, " ".join([*around[:15], letters, *around[15:]])), (2, " ".join([*around[:15], other, *around[15:]]))]
    assert got(substring.dedup(frame(spark, rows, False))) == brute(rows)


def test_columns_and_untouched(spark):
    rows = [(1, "a\n b"), (2, " ".join(f"u{i}" for i in range(25))), (3, "x " + " ".join(f"u{i}" for i in range(25)))]
    found = {r.doc_id: r for r in substring.dedup(frame(spark, rows, False), "lang", "d", "score", untouched=True).collect()}
    assert (found[1].kept, found[3].kept, found[3].lang, found[3].d, found[3].score) == ("a\n b", "x", "en", "d", "s")


def test_empty(spark):
    assert substring.dedup(frame(spark, corpus()).limit(0)).collect() == []


def test_circles(spark):
    """Text that runs in circles, alone and shared; a path that follows another only in some documents."""
    rng = random.Random(4)
    part = [f"p{i}" for i in range(70)]
    rows = [(1, "la " * 200), (2, "b " + "la " * 90 + "c"), (3, "x y z " * 60), (4, "q " + "x y z " * 40 + "q"), (5, " ".join(part)), (6, " ".join(part[:40] + ["v"] * 30 + part)), (7, " ".join(part[10:50] * 3))]
    for i in range(15):
        starts = [rng.randrange(40) for _ in range(12)]
        rows.append((10 + i, " ".join(w for a in starts for w in part[a : a + rng.randrange(15, 35)])))
    assert got(substring.dedup(frame(spark, rows, False))) == brute(rows)


def laid(*texts):
    data = [t.encode() for t in texts]
    return Words(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))


def test_digests():
    """Digests tell words by their bytes, whatever blanks stand between them and wherever texts meet."""
    texts = ["a b\n\tc", "a  b c ", "", "\vb c", "ab c", "é 日本"]
    found = laid(*texts)
    for i, text in enumerate(texts):
        own = text.encode().split()
        for lo in range(len(own)):
            for n in range(1, len(own) - lo + 1):
                want = hashlib.blake2b(b" ".join(own[lo : lo + n]), digest_size=16).digest()
                assert found.digests(found.first[[i]] + lo, n).astype("<i8").tobytes() == want


def test_equal_hashes_do_not_remove():
    """Where hashes meet and words differ, nothing goes: inside a text, and for an occurrence of a path."""
    plain, circle = " ".join(f"u{i}" for i in range(60)), "la " * 40
    for text, want in ((plain, 0), (circle, 20)):
        found = laid(text)
        found._hash = {w: np.zeros(len(found.starts), np.uint64) for w in (1, 2)}
        assert len(substring.circling(found)) == want

    own, other = laid(plain).digests(np.array([10]), 30)[0].tolist(), laid("x " + plain).digests(np.array([10]), 30)[0].tolist()
    span = 10 << 31 | 11
    pairs = pa.list_(pa.struct([("s", pa.int64()), ("v1", pa.int64()), ("v2", pa.int64())]))
    z = zstandard.ZstdCompressor().compress(plain.encode())
    runs = [[(span, *own)], [(span, *other)], None]
    batch = pa.RecordBatch.from_arrays([pa.array([z] * 3), pa.array([[], [], None], pa.list_(pa.int64())), pa.array(runs, pairs)], names=["z", "spans", "runs"])
    assert [n for part in substring._remove(False, iter([batch])) for n in part.column(1).to_pylist()] == [30, 0, 0]


def test_paths_cover_all_edges():
    rows = [(t or "").encode() for _, t in corpus()]
    _, _, text, start, edges = substring.paths(Words(np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])))
    covered = sorted((int(t), int(s) + k) for t, s, n in zip(text, start, edges) for k in range(n))
    assert covered == [(i, p) for i, t in enumerate(rows) for p in range(len(t.split()) - 19)]
    assert edges.max(initial=0) <= 15
