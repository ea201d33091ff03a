"""Exact top-k inner-product search with block-at-a-time pruning.

Vectors become integer vectors, floor(64 * x). Candidates are cut into document ranges (range partitions by id),
each stored as shards of forward indexes; a shard is read in blocks of rows, and every block has the largest and
the smallest value of each component ("term"). For a query the blocks are ordered by their summed term maxima,
an upper bound of any score inside, and scored until the bound falls below the k-th score so far. A query starts
with the k-th score of its own shard.

Shards are judged by the same bounds before anything is sent to them: the term maxima of PAGE shards make a page, each
block of queries is sent once to each page, and only the queries whose bound reaches their k-th score go on, to that
shard. Many query blocks of one shard are dealt to copies of it by a salt. Numbers are held as 32-bit integers where they
fit, as doubles otherwise.

Defined results: vectors that are null, or hold null or non-finite components, take no part, nor do rows without an
id; a shorter vector counts as padded with zeros; rows that repeat an id are candidates each, and no row with the
query's own id is its candidate; ties go to the smaller id; an empty table gives no rows; other columns are ignored.
Scores beyond the range of long saturate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, table

SCALE = 64.0
#: Rows a block, rows a shard, queries a query block, shards a page, query blocks that one copy of a shard is searched for.
BLOCK, SHARD, QUERIES, PAGE, SALTED = 256, 4096, 256, 256, 4096
_SHARDS = "shard long, ids binary, vecs binary, high binary, low binary"
_QUERIES = "ids binary, vecs binary, least binary"
_LIVE = "shard long, q_ids binary, q_vecs binary, least binary"
_FOUND = "query_id long, vec_id long, score long"


def dump(x: np.ndarray) -> bytes:
    """A matrix of whole numbers: its shape, whether it holds doubles, its numbers."""
    small = not x.size or np.abs(x).max() < 2.0**31
    return np.array([*x.shape, not small, 0], np.int32).tobytes() + np.ascontiguousarray(x, np.int32 if small else np.float64).tobytes()


def load(raw: bytes) -> np.ndarray:
    rows, width, wide, _ = np.frombuffer(raw, np.int32, 4)
    return np.frombuffer(raw, np.float64 if wide else np.int32, offset=16).reshape(rows, width).astype(np.float64)


def _rows(shape: list[tuple[str, pa.DataType, list]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for _, t, v in shape], names=[n for n, _, _ in shape])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, list of integers as doubles) to shards."""
    part = TaskContext.get().partitionId()
    held: list[tuple[int, np.ndarray]] = []
    done = 0

    def out(rows):
        m = np.zeros((len(rows), max(len(v) for _, v in rows)))
        for i, (_, v) in enumerate(rows):
            m[i, : len(v)] = v
        binary = pa.binary()
        ids = np.array([i for i, _ in rows], np.int64)
        return _rows([("shard", pa.int64(), [part << 24 | done]), ("ids", binary, [ids.tobytes()]), ("vecs", binary, [dump(m)]), ("high", binary, [dump(m.max(axis=0, keepdims=True))]), ("low", binary, [dump(m.min(axis=0, keepdims=True))])])

    for batch in batches:
        ids, vecs = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        offsets, flat = vecs.offsets.to_numpy(), np.asarray(vecs.values, np.float64)
        for i in range(batch.num_rows):
            held.append((int(ids[i]), flat[offsets[i] : offsets[i + 1]]))
            if len(held) == SHARD:
                yield out(held)
                held, done = [], done + 1
    if held:
        yield out(held)


def _alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both padded to one dimension; Python integers where doubles would not be exact."""
    dim = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (a, b))
    if dim and np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * dim >= 2.0**53:
        return np.array([[int(x) for x in r] for r in a], object).reshape(a.shape), np.array([[int(x) for x in r] for r in b], object).reshape(b.shape)
    return a, b


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The most that each query can score with any vector between low and high: summed term maxima."""
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


def block_search(q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, seen: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best k rows of x for each query among those that score at least `least`: query positions, ids, scores. seen: notes (block, queries) scored."""
    q, x = _alike(q, x)
    edges = np.arange(0, len(x), BLOCK)
    high, low = np.maximum.reduceat(x, edges, axis=0), np.minimum.reduceat(x, edges, axis=0)
    bound = bounds(q, high, low)
    order = np.argsort(-bound, axis=1, kind="stable")
    none, big = (-np.inf if q.dtype != object else -(1 << 200)), np.iinfo(np.int64).max
    best, who = np.full((len(q), k), none, q.dtype), np.full((len(q), k), big, np.int64)
    for step in range(len(edges)):
        b = order[:, step]
        live = bound[np.arange(len(q)), b] >= np.maximum(least, best[:, -1])
        if not live.any():
            break
        for at in np.unique(b[live]):
            rows = np.flatnonzero(live & (b == at))
            lo = edges[at]
            if seen is not None:
                seen.append((int(at), len(rows)))
            own = ids[lo : lo + BLOCK]
            scores = q[rows] @ x[lo : lo + BLOCK].T
            scores[own[None, :] == q_ids[rows][:, None]] = none
            floor = np.maximum(least[rows], best[rows, -1])
            if scores.dtype != object and scores.shape[1] > k:  # no more than k of a block, and ties with the k-th, can matter
                floor = np.maximum(floor, -np.partition(-scores, k - 1, axis=1)[:, k - 1])
            r, c = np.nonzero(scores >= floor[:, None])
            if not len(r):
                continue
            rows, r = rows[np.unique(r)], np.unique(r, return_inverse=True)[1]
            query = np.concatenate([np.repeat(np.arange(len(rows)), k), r])
            score = np.concatenate([best[rows].ravel(), scores[scores >= floor[:, None]]])
            name = np.concatenate([who[rows].ravel(), own[c]])
            top = np.lexsort((name, -score, query))
            top = top[np.searchsorted(query[top], np.arange(len(rows)))[:, None] + np.arange(k)]
            best[rows], who[rows] = score[top], name[top]
    at, rank = np.nonzero((best > none) & (best >= least[:, None]))
    found = best[at, rank]
    return at, who[at, rank], np.clip(found, -(2**63), 2**63 - 1) if found.dtype == object else found


def _query_blocks(every: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw_ids, raw in zip(batch.column(1), batch.column(2)):
                ids, x = np.frombuffer(raw_ids.as_py(), np.int64), load(raw.as_py())
                sel = np.flatnonzero(ids % every == 0)
                for lo in range(0, len(sel), QUERIES):
                    s = sel[lo : lo + QUERIES]
                    least = np.full(len(s), -np.inf)
                    at, _, scores = block_search(ids[s], x[s], least, ids, x, k)
                    counts = np.bincount(at, minlength=len(s))
                    if len(at):
                        last = np.cumsum(counts) - 1
                        full = counts == k
                        least[full] = np.nextafter(np.array(scores, np.float64)[last[full]], -np.inf)  # a double may round up
                    yield _rows([(n, pa.binary(), [v]) for n, v in (("ids", ids[s].tobytes()), ("vecs", dump(x[s])), ("least", least.tobytes()))])

    return run


def _stacked(matrices: list[np.ndarray]) -> np.ndarray:
    """Rows one below the other, the shorter ones filled up with zeros: a missing component is one."""
    width = max(m.shape[1] for m in matrices)
    return np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in matrices])


def _page(table_: pa.Table) -> pa.Table:
    """The bounds of a page's shards as one row."""
    high, low = (_stacked([load(x.as_py()) for x in table_[c]]) for c in ("high", "low"))
    return pa.table({"page": table_["page"][:1], "shards": pa.array([table_["shard"].to_numpy().tobytes()], pa.binary()), "high": pa.array([dump(high)], pa.binary()), "low": pa.array([dump(low)], pa.binary())})


def reaching(q: np.ndarray, least: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Matrix of which queries can score their least in which shard."""
    high, low = _alike(high, low)
    left, high = _alike(q, high)
    _, low = _alike(q, low)
    return (bounds(left, high, low) >= least[:, None]).astype(bool)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Query blocks with a page to the shards they go on to, with the queries that may find something there."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, vecs, least, shards, high, low = (batch.column(j)[i].as_py() for j in range(6))
            ids, q, least, shards = np.frombuffer(ids, np.int64), load(vecs), np.frombuffer(least), np.frombuffer(shards, np.int64)
            live = reaching(q, least, load(high), load(low))
            for s in np.flatnonzero(live.any(axis=0)):
                on = live[:, s]
                yield _rows([("shard", pa.int64(), [shards[s]]), ("q_ids", pa.binary(), [ids[on].tobytes()]), ("q_vecs", pa.binary(), [dump(q[on])]), ("least", pa.binary(), [least[on].tobytes()])])


def _score(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, q_vecs, least, ids, vecs = (batch.column(j)[i].as_py() for j in range(5))
                q_ids = np.frombuffer(q_ids, np.int64)
                at, who, scores = block_search(q_ids, load(q_vecs), np.frombuffer(least), np.frombuffer(ids, np.int64), load(vecs), k)
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(q_ids[at], pa.int64()), "vec_id": pa.array(who, pa.int64()), "score": pa.array([int(v) for v in scores] if scores.dtype == object else scores.astype(np.int64), pa.int64())})

    return run


def top_k(vectors: DataFrame, every: int, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by `every`, its k best other rows: query_id, rank, vec_id, score."""
    x = F.col("v").cast("array<double>")
    good = F.col("i").isNotNull() & F.col("v").isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).alias("v")).filter(F.coalesce(good, F.lit(False))).select("i", F.transform(x, lambda c: F.floor(c * SCALE).cast("double")).alias("v"))
    parts = max(1, -(-rows.count() // SHARD))
    shards = cut(rows.repartitionByRange(parts, "i").mapInArrow(_pack, _SHARDS))
    asked = cut(shards.select("shard", "ids", "vecs").mapInArrow(_query_blocks(every, k), _QUERIES))
    page = F.expr(f"CAST(shiftright(shard, 24) DIV {PAGE} AS INT)")
    paged = shards.select(page.alias("page"), "shard", "high", "low").groupBy("page").applyInArrow(_page, "page int, shards binary, high binary, low binary")
    salts = -(-asked.count() // SALTED)
    dealt = asked.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(max(1, salts))).cast("int"))
    copies = F.sequence(F.lit(0), F.lit(max(0, salts - 1)))
    met = dealt.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit((parts - 1) // PAGE)))).join(paged.withColumn("salt", F.explode(copies)), ["page", "salt"])
    live = met.select("ids", "vecs", "least", "shards", "high", "low").mapInArrow(_judge, _LIVE).withColumn("salt", F.pmod(F.xxhash64("q_ids"), F.lit(max(1, salts))).cast("int"))
    found = live.join(shards.select("shard", "ids", "vecs").withColumn("salt", F.explode(copies)), ["shard", "salt"]).select("q_ids", "q_vecs", "least", "ids", "vecs").mapInArrow(_score(k), _FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), every=20, k=20)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
