"""Exact substring deduplication by a compacted de Bruijn graph of words.

Every window of twenty consecutive words is an edge of the de Bruijn graph (from its first nineteen words to its last
nineteen). A text walks along edges; the walk is cut into paths at its anchors: an edge's anchor is its six-word gram
of the smallest hash (the leftmost of several), and the edges that share one anchor follow each other without a
branch inside the text, so they are compacted to one path with one content hash. Equal edges have equal anchors, so
everything that repeats is found by Spark joins on anchors, a fifteenth to a seventh of the number of words:

1. Inside a document, whatever repeats is seen where its text is, when its words are removed; so of the paths of equal
   content in a document only the first goes on (text that runs in circles gives few rows). Anchors of a single
   document are dropped with their paths.
2. Paths of equal anchor and content are one repeated path, with its number of occurrences, its first one (by
   document, start) and the paths before it. A path that always follows the same path, which occurs as often, does not
   branch: in the document of their first occurrences, where their coordinates must meet, such paths are compacted to
   one long path. Every occurrence of a long path but its first is removed whole; one join finds them by its start.
3. Where an anchor has several contents (the ends of repeated passages), the first occurrence of each content is
   opened into its edges, which are compared one by one by the digests of their words; occurrences after the first are
   removed.
4. Source coordinates (document, start, number of edges) are carried along all the way: they decide which occurrence
   is first. A long path's first occurrence is read again from its coordinates in its text and digested; every other
   occurrence is digested where it is to be removed, and stays if the two differ.

So hashes only find candidates; what is removed has the words of its first occurrence by 128 bits of BLAKE2b of the
words themselves. Edges that repeat inside one text are compared in the same way.

A row is known by its id; where any id stands in more than one row, by its id and 128 bits of its text's hash.

Defined results: null text has no words; repeated rows fare alike, none takes words from the other; rows that repeat an
id with another text are documents of their own, in the order of their texts' hashes; rows without an id come before
all others; texts shorter than a window lose nothing; a text is handled whole; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import U, Words, cut, doc_key, joined, mix, pieces, table, utf8

K, ANCHOR = 20, 6
#: A place in one number, in the order of places of one row: the start, then 4 bits of the number of edges (up to 15).
#: A span: the start, then 31 bits of the number of edges.
_START, _LONG = (1 << 31) - 1, 31
#: What a row is known by: its id, and two hashes of its text (0 where ids don't repeat).
ROW = ["d", "t", "u"]


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    done, out = 1, a
    while done * 2 <= width:
        out, done = np.minimum(out[:-done], out[done:]), done * 2
    return out if done == width else np.minimum(out[: len(a) - width + 1], out[width - done :][: len(a) - width + 1])


def paths(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The compacted paths of all texts: anchor hash, content hash, text, start in the text, number of edges."""
    begin, _ = words.windows(K)
    if not len(begin):
        none = np.zeros(0, np.int64)
        return none.astype(U), none.astype(U), none, none, none
    grams = words.every(ANCHOR)
    least = _sliding_min((grams >> U(32) << U(32)) | np.arange(len(grams), dtype=U), K - ANCHOR + 1)
    anchor = (least[begin] & U(0xFFFFFFFF)).astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    start, edges = begin[at], np.diff(np.append(at, len(begin)))
    text = words.text[start]
    edge = words.every(K, 2)  # a path's first and last edges cover all its words, since it has fewer edges than an edge has words
    return grams[anchor[at]], joined(edge[start], edge[start + edges - 1] + edges.astype(U)), text, start - words.first[text], edges


def _once(text: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Where a value stands for the first time in its text."""
    _, first = np.unique(mix(value ^ mix(text.astype(U) + U(1))), return_index=True)
    flags = np.zeros(len(value), bool)
    flags[first] = True
    return flags


def _anchors(whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            m, c, text, start, edges = paths(Words(*utf8(batch.column(3))))
            if not len(m):
                continue
            if not whole:
                yield pa.RecordBatch.from_arrays([pa.array(m[_once(text, m)].view(np.int64))], names=["m"])
                continue
            keep = _once(text, c)
            row = [batch.column(i).to_numpy()[text] for i in range(3)]
            # the content before, 0 where none goes on in front of it
            before = np.concatenate([[0], np.where(keep, c.view(np.int64), 0)[:-1]])
            before[start == 0] = 0
            columns = m.view(np.int64), c.view(np.int64), *row, start << 4 | edges, before
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in columns], names=["m", "c", *ROW, "at", "before"])

    return run


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text column (the fourth) compressed: whole texts are shuffled twice."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        raw, offsets = utf8(batch.column(3))
        small = pa.array([pack.compress(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], small, *batch.columns[4:]], names=[*batch.schema.names[:3], "z", *batch.schema.names[4:]])


def _open(z: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    unpack = zstandard.ZstdDecompressor()
    texts = [unpack.decompress(x.as_buffer(), allow_extra_data=False) for x in z]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _listed(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The elements of a list column, and the row of each; a null list has none."""
    return lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts, the paths to open in them, and the long paths whose first occurrence they hold: to edges, and to the paths' digests (at: -1)."""
    names = ["h1", "h2", *ROW, "at", "m", "c"]
    for batch in pieces(batches, "z", 400_000):
        words = Words(*_open(batch.column(3)))
        spans, owner = _listed(batch.column(4))
        packed = spans.to_numpy()
        n = packed & _START
        text = np.repeat(owner, n)
        start = np.repeat(packed >> _LONG, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        digests = words.digests(words.first[text] + start, K)
        rows = [pa.array(batch.column(i).to_numpy()[text]) for i in range(3)]
        none = pa.nulls(len(text), pa.int64())
        yield pa.RecordBatch.from_arrays([*map(pa.array, digests.T), *rows, pa.array(start << 4 | 1), none, none], names=names)
        sources, owner = _listed(batch.column(5))
        packed, *path = (sources.field(i) for i in range(3))
        packed = packed.to_numpy()
        digests = words.digests(words.first[owner] + (packed >> _LONG), (packed & _START) + K - 1)
        rows = [pa.array(batch.column(i).to_numpy()[owner]) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, digests.T), *rows, pa.array(np.full(len(owner), -1)), *path], names=names)


def circling(words: Words) -> np.ndarray:
    """First words of the edges that stand in their text before."""
    begin, _ = words.windows(K)
    if not len(begin):
        return begin
    text = words.text[begin]
    one, two = (words.window_hash(begin, K, w) for w in (1, 2))
    order = np.argsort(mix(one ^ mix(text.astype(U) + U(1))), kind="stable")
    a, b = order[:-1], order[1:]
    met = (one[a] == one[b]) & (two[a] == two[b]) & (text[a] == text[b])
    if not met.any():
        return begin[:0]
    a, b = begin[a[met]], begin[b[met]]
    return b[(words.digests(a, K) == words.digests(b, K)).all(axis=1)]


def _remove(untouched: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words that their spans, or edges that their text has before, cover.

    The columns z (compressed text), spans (of edges) and runs (spans of paths with the digest of their first
    occurrence, which their words must have) become results.
    """
    for batch in pieces(batches, "z", 400_000):
        data, offsets = _open(batch.column(0))
        words = Words(data, offsets)
        spans, owner = _listed(batch.column(1))
        packed = spans.to_numpy()
        runs, whose = _listed(batch.column(2))
        run, *proof = (runs.field(i).to_numpy() for i in range(3))
        same = (words.digests(words.first[whose] + (run >> _LONG), (run & _START) + K - 1) == np.stack(proof, axis=1)).all(axis=1)
        packed, owner = np.concatenate([packed, run[same]]), np.concatenate([owner, whose[same]])
        begin = words.first[owner] + (packed >> _LONG)
        again = circling(words)
        mark = np.zeros(len(words.starts) + 1, np.int64)
        np.add.at(mark, begin, 1)
        np.add.at(mark, begin + (packed & _START) + K - 1, -1)
        np.add.at(mark, again, 1)
        np.add.at(mark, again + K, -1)
        gone = np.cumsum(mark[:-1]) > 0
        n_removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[np.append(words.first, len(words.starts))])
        kept = []
        for i in range(batch.num_rows):
            text = data[offsets[i] : offsets[i + 1]].tobytes()
            if n_removed[i]:
                left = ~gone[words.first[i] : words.first[i] + words.counts[i]]
                kept.append(b" ".join(itertools.compress(text.split(), left.tolist())))
            else:
                kept.append(text if untouched else b" ".join(text.split()))
        rest = batch.columns[3:]
        yield pa.RecordBatch.from_arrays([pa.array(words.counts, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).view(pa.string()), *rest], names=["n_words", "n_removed", "kept", *batch.schema.names[3:]])


def _place(at: Column) -> tuple[Column, Column]:
    """Of a place in one number: the start, the number of edges."""
    return F.shiftright(at, 4), at.bitwiseAND(15)


def _later() -> Column:
    return F.struct(*ROW, "at") > F.col("f")


def _first() -> Column:
    return F.min(F.struct(*ROW, "at")).alias("f")


def _span(start: Column, edges: Column) -> Column:
    return F.shiftleft(start, _LONG).bitwiseOR(edges.cast("long")).alias("s")


def compacted(table_: DataFrame) -> DataFrame:
    """Repeated paths (m, c, f, n, least and most of the contents before) to long paths: m and c of the start, f, edges of all.

    A path and the one before it meet where they stand together in the document of their first occurrences; the window
    that joins them runs along that document, so no group is larger than a document.
    """
    start, edges = _place(F.col("f.at"))
    rows = table_.filter("n > 1").select("m", "c", "n", "least", "most", "f", "f.d", "f.t", "f.u", start.alias("p"), edges.alias("e"))
    along = Window.partitionBy(*ROW).orderBy("p")
    back = lambda c: F.lag(c).over(along)
    inner = (F.col("least") == F.col("most")) & (back("c") == F.col("least")) & (back("n") == F.col("n")) & (back("p") + back("e") == F.col("p"))
    runs = rows.withColumn("head", F.when(F.coalesce(inner, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("head").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    one = runs.groupBy(*ROW, "run").agg(F.min_by(F.struct("m", "c", "f"), "p").alias("start"), F.sum("e").alias("edges"))
    return one.select("start.*", "edges")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """ROW, and what to remove from it, for those rows of _keyed's that have any: spans (start << 31 | edges), and runs (a span, the digest its words must have)."""
    docs = docs.select(*ROW, "text")
    row = "d long, t long, u long"
    repeated = cut(docs.mapInArrow(_anchors(False), "m long").groupBy("m").agg(F.count("*").alias("n")).filter("n > 1").select("m"))
    walked = cut(docs.mapInArrow(_anchors(True), f"m long, c long, {row}, at long, before long").join(repeated, "m"))
    contents = cut(walked.groupBy("m", "c").agg(_first(), F.count("*").alias("n"), F.min("before").alias("least"), F.max("before").alias("most")))
    start, edges = _place(F.col("at"))
    longs = cut(compacted(contents))
    several = cut(contents.groupBy("m").agg(F.count("*").alias("n")).filter("n > 1").select("m"))
    ends = contents.select("m", "f.*").join(several, "m").select(*ROW, _span(start, edges), F.lit(None).alias("p"))
    firsts = longs.select("f.*", "m", "c", "edges").select(*ROW, F.lit(None).alias("s"), F.struct(_span(start, F.col("edges")), "m", "c").alias("p"))
    asked = ends.union(firsts).groupBy(*ROW).agg(F.collect_list("s").alias("spans"), F.collect_list("p").alias("sources"))
    opened = cut(docs.mapInArrow(_squeeze, f"{row}, z binary").join(asked.hint("merge"), ROW).mapInArrow(_read, f"h1 long, h2 long, {row}, at long, m long, c long"))
    proofs = opened.filter("at < 0").select("m", "c", F.col("h1").alias("v1"), F.col("h2").alias("v2")).dropDuplicates(["m", "c"])
    opened = opened.filter("at >= 0").drop("m", "c")
    later_paths = walked.join(longs.join(proofs, ["m", "c"]), ["m", "c"]).filter(_later()).select(*ROW, F.lit(None).alias("s"), F.struct(_span(start, F.col("edges")), "v1", "v2").alias("p"))
    edge_firsts = cut(opened.groupBy("h1", "h2").agg(_first(), F.count("*").alias("n")).filter("n > 1").drop("n"))
    later_edges = opened.join(edge_firsts, ["h1", "h2"]).filter(_later()).select(*ROW, _span(start, edges), F.lit(None).alias("p"))
    return later_paths.union(later_edges).groupBy(*ROW).agg(F.collect_list("s").alias("spans"), F.collect_list("p").alias("runs"))


def _keyed(documents: DataFrame, *more: str) -> DataFrame:
    """Of every row ROW, text and further columns own_0, own_1, ..."""
    text, d = F.coalesce(F.col("text").cast("string"), F.lit("")), doc_key(F.col("doc_id"))
    again = not documents.groupBy(d.alias("d")).count().filter("count > 1").isEmpty()
    tags = [F.xxhash64(text), F.xxhash64(F.lit(7), text)] if again else [F.lit(0).cast("long")] * 2
    return documents.select(*(c.alias(n) for c, n in zip([d, *tags, text], [*ROW, "text"])), *(F.col(c).alias(f"own_{i}") for i, c in enumerate(more)))


def dedup(documents: DataFrame, *more: str, untouched: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by single blanks), and further columns of documents on request.

    untouched: a text that loses no word stays as it is, blanks included.
    """
    types = dict(documents.dtypes)
    docs = _keyed(documents, "doc_id", *more)
    spans = cut(repeated_spans(docs))
    own = "".join(f", own_{i} {types[c]}" for i, c in enumerate(("doc_id", *more)))
    texts = docs.mapInArrow(_squeeze, f"d long, t long, u long, z binary{own}").join(spans.hint("merge"), ROW, "left").drop(*ROW)
    rows = texts.select("z", "spans", "runs", *(f"own_{i}" for i in range(1 + len(more)))).mapInArrow(functools.partial(_remove, untouched), f"n_words long, n_removed long, kept string{own}")
    return rows.select(F.col("own_0").cast("long").alias("doc_id"), "n_words", "n_removed", "kept", *(F.col(f"own_{i}").alias(c) for i, c in enumerate(more, 1)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, p, array_to_string(list_slice(w, p, p + 19), chr(1)) AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d)),
later AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, p + i AS p FROM later, range(20) t(i)),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT word.doc_id, word.p, x FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p WHERE gone.p IS NULL),
k AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS text FROM kept GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
