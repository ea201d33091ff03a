"""Quality classifier: a generalised additive model with pairwise interactions.

A text becomes a few shape features (characters by kind, repetition of words and lines, lengths); labels, language,
source and id are never inputs. The model is a sum of lookup tables, one per feature over its quantile bins, and one
per chosen pair of features over both bins. Training is cyclic boosting of shallow trees on the logistic loss: round
after round, each feature in turn gets a tree of at most three leaves over its bins, added to its table with a small
step; pairs are ranked by what a two-by-two split explains of the remaining gradient, and then boosted in turn as well.
Scoring adds the tables' entries for all rows at once and takes the logistic function.

The model is fitted on the driver on at most SAMPLE labelled rows (those of the smallest hash of their id; a bound, not
a share), none of them held out; only they are measured for it. Everything else covers all rows, each measured once.

Defined results: null text is empty; the empty text is scored like any other; repeated rows get equal scores; of a
document with several labels the majority counts (ties: 1); labels other than 0 and 1 are ignored; without labels of
both kinds the score is the smoothed share of label 1 (0.5 without any); rows without an id are scored, not held out,
and not learnt from; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import U, Words, byte_hash, pieces, table, utf8

SAMPLE = 20_000
THRESHOLD = 0.7
BINS, ROUNDS, PAIR_ROUNDS, PAIRS, STEP, RIDGE = 32, 160, 80, 6, 0.1, 2.0
_COARSE = 8
#: Text bytes measured at once; the counters along the bytes take a hundred times as much.
PIECE = 200_000

FEATURES = (
    "log_words", "log_bytes", "word_length", "upper", "digits", "symbols", "marks", "wide", "lone_symbol_words", "symbol_ends",
    "stutter", "distinct", "top_share", "words_per_line", "line_repeats", "stops", "exclaims", "starts_upper",
)


def _kinds() -> np.ndarray:
    kind = np.zeros((8, 256), bool)
    kind[0, 65:91] = True
    kind[1, 48:58] = True
    for c in b"#$%&*|@^~_=+<>/\\{}[]":
        kind[2, c] = True
    for c in b".,;:?'\"-()":
        kind[3, c] = True
    kind[4, 128:] = True
    kind[5, 33] = True
    kind[6, 10] = True
    kind[7, 97:123] = True
    return kind


_KIND = _kinds()


def _per(cumulative: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return cumulative[offsets[1:]] - cumulative[offsets[:-1]]


def _counts(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags)])


def _repeats(owner: np.ndarray, hashes: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the count of the most frequent one, for each text."""
    key = np.sort(owner.astype(U) << U(40) | hashes >> U(24))
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    o = (key >> U(40)).astype(np.int64)
    at = np.flatnonzero(new)
    distinct = np.bincount(o[at], minlength=texts)
    most = np.zeros(texts, np.int64)
    np.maximum.at(most, o[at], np.diff(np.append(at, len(o))))
    return distinct, most


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts by FEATURES."""
    n = len(offsets) - 1
    w = Words(data, offsets)
    size = np.maximum(np.diff(offsets), 1)
    count = np.maximum(w.counts, 1)
    edges = np.append(w.first, len(w.starts))
    kinds = [_counts(k[data]) for k in _KIND]
    upper, digits, symbols, marks, wide, exclaims, feeds, lower = (_per(k, offsets) for k in kinds)
    letters = np.maximum(upper + lower + wide, 1)
    odd = kinds[2] + kinds[5]
    inside = odd[w.ends] - odd[w.starts]
    length = w.ends - w.starts
    hashes = w.hash(1)
    same = np.zeros(len(hashes), bool)
    if len(hashes) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (w.text[1:] == w.text[:-1])
    distinct, most = _repeats(w.text, hashes, n)
    last = data[w.ends - 1] if len(w.ends) else np.zeros(0, np.uint8)
    head = data[w.starts] if len(w.starts) else np.zeros(0, np.uint8)
    per_word = lambda flags: _per(_counts(flags), edges) / count
    # lines: cut at line feeds and text ends, blank ones included
    start = np.union1d(offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(data == 10) + 1)
    start = start[start < len(data)].astype(np.int64)
    end = np.append(start[1:], len(data))
    line_text = np.searchsorted(offsets, start, "right") - 1
    line_hash = byte_hash(data, start, end, 3)
    lines = np.bincount(line_text, minlength=n) if len(start) else np.zeros(n, np.int64)
    distinct_lines, _ = _repeats(line_text, line_hash, n)
    columns = [
        np.log1p(w.counts), np.log1p(np.diff(offsets)), _per(_counts(length), edges) / count, upper / letters, digits / size, symbols / size, marks / size, wide / size,
        per_word(inside == length), per_word(_KIND[2][last] | _KIND[5][last]),
        per_word(same), distinct / count, most / count, w.counts / np.maximum(lines, 1), 1 - distinct_lines / np.maximum(lines, 1), per_word(length <= 3), exclaims / size, per_word(_KIND[0][head]),
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], axis=1)


class Gam:
    """Lookup tables over feature bins and pairs of bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n = len(y)
        positive = float(y.sum())
        self.base = float(np.log((positive + 0.5) / (n - positive + 0.5))) if n else 0.0
        self.edges = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) if n else np.zeros(0) for c in (x.T if n else np.zeros((len(FEATURES), 0)))]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        if not 0 < positive < n:
            return
        bins = self._bins(x)
        logit = np.full(n, self.base)
        for _ in range(ROUNDS):
            for f, own in enumerate(self.tables):
                if len(own) < 2:
                    continue
                g, h = self._gradient(y, logit)
                step = self._tree(np.bincount(bins[f], g, len(own)), np.bincount(bins[f], h, len(own)))
                own += step
                logit += step[bins[f]]
        for i, j in self._rank(bins, y, logit):
            self.pairs.append((i, j, np.zeros((len(self.tables[i]), len(self.tables[j])))))
        for _ in range(PAIR_ROUNDS):
            for i, j, own in self.pairs:
                g, h = self._gradient(y, logit)
                at = bins[i] * own.shape[1] + bins[j]
                step = self._quarters(np.bincount(at, g, own.size).reshape(own.shape), np.bincount(at, h, own.size).reshape(own.shape))[1]
                own += step
                logit += step[bins[i], bins[j]]

    def _bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)]

    @staticmethod
    def _gradient(y: np.ndarray, logit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    @staticmethod
    def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """A tree of at most three leaves over ordered bins, as a step for each bin."""
        leaves = [(0, len(g))]
        for _ in range(2):
            best = (1e-9, None, None)
            for lo, hi in leaves:
                a, b = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
                if hi - lo < 2:
                    continue
                gain = a[:-1] ** 2 / (b[:-1] + RIDGE) + (a[-1] - a[:-1]) ** 2 / (b[-1] - b[:-1] + RIDGE) - a[-1] ** 2 / (b[-1] + RIDGE)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = gain[k], (lo, hi), lo + k + 1
            if best[1] is None:
                break
            leaves.remove(best[1])
            leaves += [(best[1][0], best[2]), (best[2], best[1][1])]
        step = np.zeros(len(g))
        for lo, hi in leaves:
            step[lo:hi] = STEP * g[lo:hi].sum() / (h[lo:hi].sum() + RIDGE)
        return step

    @staticmethod
    def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        """The best split of a grid into four: what it explains, and the step for each cell."""
        a, b = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
        if min(g.shape) < 2:
            return 0.0, np.zeros(g.shape)
        parts = lambda c: (c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1])
        gain = sum(x**2 / (np.maximum(z, 0) + RIDGE) for x, z in zip(parts(a), parts(b)))
        r, c = np.unravel_index(int(np.argmax(gain)), gain.shape)
        step = np.zeros(g.shape)
        for rows in (slice(0, r + 1), slice(r + 1, None)):
            for cols in (slice(0, c + 1), slice(c + 1, None)):
                step[rows, cols] = STEP * g[rows, cols].sum() / (h[rows, cols].sum() + RIDGE)
        return float(gain[r, c]), step

    def _rank(self, bins: list[np.ndarray], y: np.ndarray, logit: np.ndarray) -> list[tuple[int, int]]:
        g, h = self._gradient(y, logit)
        coarse = [b * _COARSE // max(1, len(t)) for b, t in zip(bins, self.tables)]
        found = []
        for i in range(len(bins)):
            for j in range(i):
                if len(self.tables[i]) > 1 and len(self.tables[j]) > 1:
                    at = coarse[i] * _COARSE + coarse[j]
                    shape = (_COARSE, _COARSE)
                    found.append((-self._quarters(np.bincount(at, g, 64).reshape(shape), np.bincount(at, h, 64).reshape(shape))[0], i, j))
        return [(i, j) for _, i, j in sorted(found)[:PAIRS]]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self._bins(x)
        logit = np.full(len(x), self.base)
        for b, own in zip(bins, self.tables):
            logit += own[b]
        for i, j, own in self.pairs:
            logit += own[bins[i], bins[j]]
        return 1 / (1 + np.exp(-logit))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, limit=PIECE):
        x = features(*utf8(batch.column(batch.schema.get_field_index("text"))))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
        rest = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n != "text"]
        yield pa.RecordBatch.from_arrays([*(c for _, c in rest), lists], names=[*(n for n, _ in rest), "x"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Gam:
    """The model of labels (doc_id, quality), on at most `sample` documents that aren't held out."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    # Beforehand, about the right share of ids by their hash: a bounded number, which is sent to where the texts are.
    share = 1.5 * sample / max(1, known.count())
    low = F.xxhash64("doc_id").cast("double") / 2.0**64 + 0.5 < share
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known.filter(low)), "doc_id")
    rows = texts.select("doc_id", "y", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_measure, "doc_id long, y int, x array<double>")
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(sample).select("y", "x").toArrow()
    x = chosen["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(chosen.num_rows, len(FEATURES))
    return Gam(x, chosen["y"].to_numpy().astype(np.float64))


def _scores(model: Gam):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=PIECE):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(features(*utf8(batch.column(1)))))], names=["doc_id", "score"])

    return run


def classify(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    scored = rows.mapInArrow(_scores(fit(documents, labels, sample)), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _filter(model: Gam, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=PIECE):
            yield batch.filter(pa.array(model.score(features(*utf8(batch.column(batch.schema.get_field_index("text"))))) >= threshold))

    return run


def keep(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The documents that the classifier, fitted on them, predicts to be of quality 1, with all their columns."""
    return documents.mapInArrow(_filter(fit(documents, labels, sample), threshold), documents.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = None
