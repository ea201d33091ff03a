"""Small fixtures shared by the corpus operators' tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d string, m int, score string, x string, rep string"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=1):
    """(doc_id, text): plain texts, copies, near copies, shared passages, periodic, blank, short and long ones."""
    rng = random.Random(seed)
    passage, base = words(rng, 60), words(rng, 200)
    texts = [" ".join(words(rng, rng.randrange(1, 120))) for _ in range(30)]
    texts += [texts[3], texts[3], texts[7]]
    for k in (1, 2, 4, 12, 40):
        near = list(base)
        for _ in range(k):
            near[rng.randrange(len(near))] = f"z{rng.randrange(1000)}"
        texts.append("\n".join([" ".join(near[:90]), " ".join(near[90:])]))
    texts += [" ".join(base), " ".join(words(rng, 30) + passage + words(rng, 10)), "\t".join(passage), " ".join(passage[5:50] + words(rng, 5) + passage[:30])]
    texts += ["", " \n\t ", None, "one", "one two", "one", "a b c d e", "a b c d e f", "la " * 70, "x y " * 30, "é 日本 🙂 " * 12, "   a b", " ".join(words(rng, 6000, 90_000))]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts))


def frame(spark, rows, repeated=True):
    """documents with clashing extra columns; a row without an id and, if asked for, repeated rows."""
    rows = list(rows)
    if repeated:
        rows += [rows[0], rows[34], (None, rows[5][1])]
    full = [(i, t, "en", None if i is None or i % 7 == 0 else f"s{i % 4}", None, "d", 1, "s", "x", "r") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)
