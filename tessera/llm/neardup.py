"""N-gram Jaccard join by MinHash banding.

Texts become sets of five-word shingles (a text of one to four words is one shingle). Equal texts are one class from
the start. Each class gets BANDS * ROWS min-hashes; a band's ROWS values make one hash, and classes are shuffled on
band hashes. BANDS and ROWS are chosen for the target recall: a pair of similarity s shares a band with probability
1 - (1 - s**ROWS)**BANDS, which is above 0.99997 at 0.8. The pairs of classes that share a band are the candidates, and
every candidate is verified on its full n-gram sets.

Pairs never become rows: groups of classes are compared in blocks. Buckets are connected to components first, which are
the groups; of components of more than MOST_PARTS parts, where texts are mostly chained together without sharing a
band, the groups are their buckets, those of equal members being one. A group is parted, and each two parts make a
block. A block looks only at pairs that share a band, and a pair that meets in several groups counts in the group of
the first band it shares, so the links are the same either way. A block gives each member its number of links and its
smallest linked member; components over these are the classes. No partner is capped or dropped.

Defined results: null and blank texts have no shingles, are linked to nothing and are classes of their own; repeated
rows are copies of each other; classes are told apart by their texts (two 64-bit hashes), never by ids, so rows that
share an id (or have none) but not a text are documents of their own; a null id comes before all others and its class
id is null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import U, WORD, Words, cut, doc_key, mix, pieces, table, utf8
from tessera.llm.graph import components

N, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 4
#: Most classes and shingles a verification part holds on average; larger groups are parted.
PART_CLASSES, PART_SHINGLES = 128, 200_000
#: Parts of a component from which on its buckets are compared instead; every text of a component goes to all its parts.
MOST_PARTS = 64
_MUL = mix(np.arange(1, BANDS * ROWS + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
_ADD = mix(np.arange(1, BANDS * ROWS + 1, dtype=U) * U(0xD1342543DE82EF95))


def shingles(words: Words, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """64-bit shingles of all texts in order, and how many each text has (repeats included)."""
    per = np.where(words.counts >= n, words.counts - n + 1, np.minimum(words.counts, 1))
    owner = np.repeat(np.arange(len(per)), per)
    begin = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + words.first[owner]
    size = np.minimum(words.counts[owner], n)
    out = np.empty(len(begin), U)
    for k in np.unique(size):
        out[size == k] = words.window_hash(begin[size == k], int(k))
    return out, per


def band_hashes(sh: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Band hashes (texts by BANDS) of texts with at least one shingle each."""
    out = np.empty((len(per), BANDS * ROWS), U)
    ends = np.cumsum(per)
    lo = 0
    while lo < len(per):  # some texts at a time, so that the hashes stay in the cache
        base = ends[lo] - per[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + 32_768, "right")))
        own, edges = sh[base : ends[hi - 1]], (ends[lo:hi] - per[lo:hi] - base)
        for j in range(BANDS * ROWS):
            out[lo:hi, j] = np.minimum.reduceat(own * _MUL[j] + _ADD[j], edges)
        lo = hi
    bands = np.zeros((len(per), BANDS), U)
    for r in range(ROWS):
        bands = mix(bands * U(0x9E3779B97F4A7C15) + out.reshape(len(per), BANDS, ROWS)[:, :, r])
    return mix(bands + np.arange(1, BANDS + 1, dtype=U))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        sh, per = shingles(Words(*utf8(batch.column(3))))
        some = per > 0
        if not some.any():
            continue
        bands = band_hashes(sh, per[some]).view(np.int64)
        mask = pa.array(some)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
        yield pa.RecordBatch.from_arrays([*(batch.column(i).filter(mask) for i in range(3)), pa.array(per[some], pa.int64()), lists], names=["d", "k1", "k2", "n", "bands"])


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Matrix of which sets named by left have a Jaccard similarity of at least the threshold with which named by right."""
    sizes = np.array([len(s) for s in sets], np.float64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    names, which, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.cumsum(shared) - 1
    keep = shared[which]
    owner, at = owner[keep], column[which[keep]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    common = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(at, [lo, lo + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[a:b], at[a:b] - lo] = 1
        common += m[left] @ m[right].T
    both = sizes[left][:, None] + sizes[right][None, :] - common
    return common >= threshold * both - 1e-9


def candidates(bands: np.ndarray, groups: np.ndarray, group: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Matrix of the pairs that share a band, and whose first shared band belongs to this group."""
    own, open_ = np.zeros((len(left), len(right)), bool), np.ones((len(left), len(right)), bool)
    for j in range(bands.shape[1]):
        same = (bands[left, j][:, None] == bands[right, j][None, :]) & open_
        own |= same & (groups[left, j] == group)[:, None]
        open_ &= ~same
    return own


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each of n nodes' components."""
    label = np.arange(n)
    while len(a):
        old = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (old == label).all():
            break
    return label


_BLOCK = "node long, links long, root long"


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    return lists.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(lists), BANDS)


def _verify(table_: pa.Table) -> pa.Table:
    """A block's texts to its members' links; rows of one class count once."""
    _, first = np.unique(table_["node"].to_numpy(), return_index=True)
    table_ = table_.take(pa.array(first))
    node, part, copies = (table_[c].to_numpy() for c in ("node", "part", "copies"))
    group, ha, hb = (table_[c][0].as_py() for c in ("grp", "ha", "hb"))
    sh, per = shingles(Words(*utf8(table_["text"])))
    sets = [np.unique(s) for s in np.split(sh, np.cumsum(per)[:-1])]
    left, right = np.flatnonzero(part == ha), np.flatnonzero(part == hb)
    if not len(left) or not len(right):
        return pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
    hit = linked(sets, left, right) & candidates(_matrix(table_["bands"]), _matrix(table_["groups"]), group, left, right)
    links = np.zeros(len(node), np.int64)
    i, j = np.nonzero(hit)
    i, j = left[i], right[j]
    i, j = i[i != j], j[i != j]
    np.add.at(links, i, copies[j])
    if ha != hb:
        np.add.at(links, j, copies[i])
    label = roots(len(node), i, j)
    lowest = np.full(len(node), np.iinfo(np.int64).max)
    np.minimum.at(lowest, label, node)
    some = np.unique(np.concatenate([i, j]))
    return pa.table({"node": node[some], "links": links[some], "root": lowest[label[some]]})


def _parts(classes: Column, shingles_: Column) -> Column:
    return F.greatest(F.ceil(classes / PART_CLASSES), F.ceil(shingles_ / PART_SHINGLES), F.lit(1)).cast("int")


def _groups(classes: DataFrame) -> DataFrame:
    """The groups in which classes are compared: grp, node, parts of the group, and `groups`, the node's group by band (0: alone there)."""
    banded = classes.select("node", "n", F.posexplode("bands").alias("band", "h"))
    buckets = banded.groupBy("band", "h").agg(F.min("node").alias("head"), F.count("*").alias("c"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("node")).alias("x")).filter("c > 1")
    # Buckets of equal members have equal names; should different ones meet, they are one larger group.
    buckets = cut(buckets.select("band", "h", "head", F.xxhash64("c", "total", "head", "x").alias("name"), _parts(F.col("c"), F.col("total")).alias("parts")))
    met = cut(banded.join(buckets, ["band", "h"]).select("node", "n", "band", "head", "name", "parts"))
    # A class is linked to the smallest of its buckets' heads, and the other heads to that one: the components are the
    # same, and classes that share their heads share those links.
    heads = met.groupBy("node").agg(F.array_sort(F.collect_set("head")).alias("heads"))
    own = heads.select(F.get("heads", F.lit(0)).alias("a"), F.col("node").alias("b"))
    among = heads.filter(F.size("heads") > 1).select(F.col("heads").getItem(0).alias("a"), F.explode(F.slice("heads", 2, BANDS)).alias("b")).distinct()
    near = components(own.union(among).filter("a <> b")).select("node", F.col("root").alias("comp"))
    sized = near.join(classes.select("node", "n"), "node").groupBy("comp").agg(_parts(F.count("*"), F.sum("n")).alias("in_parts"))
    placed = met.join(near.join(sized, "comp"), "node")
    whole = F.col("in_parts") <= MOST_PARTS
    # at most one row a band: a class's groups are a bounded list
    name, parts = F.when(whole, F.col("comp")).otherwise(F.col("name")), F.when(whole, F.col("in_parts")).otherwise(F.col("parts"))
    rows = placed.select("node", "band", name.alias("grp"), parts.alias("parts"))
    by_node = rows.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("band", "grp"))).alias("by_band"), F.collect_set(F.struct("grp", "parts")).alias("own"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.coalesce(F.try_element_at("by_band", j), F.lit(0).cast("long")))
    return cut(by_node.select("node", filled.alias("groups"), "own"))


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _hashes() -> list[Column]:
    """Two hashes of a text, which together name its class."""
    return [F.xxhash64(_text()), F.xxhash64(F.lit(7), _text())]


def _classed(documents: DataFrame) -> DataFrame:
    """Of every class of equal texts that aren't blank the texts' hashes k1 and k2, node, rep (the smallest id), copies, links, root and the root's id root_rep."""
    k1, k2 = _hashes()
    docs = documents.select(doc_key(F.col("doc_id")).alias("d"), k1.alias("k1"), k2.alias("k2"), _text().alias("text"))
    signed = docs.mapInArrow(_sign, "d long, k1 long, k2 long, n long, bands array<long>")
    grouped = signed.groupBy("k1", "k2").agg(F.min("d").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    # Classes are numbered in the order of their smallest ids, which several may share.
    classes = cut(grouped.orderBy("rep", "k1", "k2").withColumn("node", F.monotonically_increasing_id() + 1))
    members = classes.join(_groups(classes), "node").withColumnRenamed("rep", "d")
    texts = docs.join(members.hint("merge"), ["d", "k1", "k2"]).select("node", "copies", "bands", "groups", "text", F.inline("own"))
    texts = texts.withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = texts.select("grp", F.least("part", "other").alias("ha"), F.greatest("part", "other").alias("hb"), "node", "part", "copies", "bands", "groups", "text")
    found = cut(blocks.groupBy("grp", "ha", "hb").applyInArrow(_verify, _BLOCK))
    roots_ = components(found.select(F.col("root").alias("a"), F.col("node").alias("b"))).select("node", "root")
    totals = found.groupBy("node").agg(F.sum("links").alias("links")).join(roots_, "node", "left")
    totals = totals.join(classes.select(F.col("node").alias("root"), F.col("rep").alias("root_rep")), "root", "left")
    return cut(classes.select("k1", "k2", "node", "rep", "copies").join(totals, "node", "left"))


def jaccard_join(documents: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest id of its near-duplicate component), copy_id (of its class of equal texts), n_links (other documents of similarity 0.8 or more)."""
    own = doc_key(F.col("doc_id"))
    known = lambda c: F.when(c != -(2**63), c)
    k1, k2 = _hashes()
    return documents.select("doc_id", k1.alias("k1"), k2.alias("k2")).join(_classed(documents), ["k1", "k2"], "left").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        known(F.coalesce("root_rep", "rep", own)).alias("class_id"),
        known(F.coalesce("rep", own)).alias("copy_id"),
        (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
    )


def keep_one(documents: DataFrame) -> DataFrame:
    """The documents with one of each near-duplicate component, the one of the smallest id (of several texts with that id, the one of the smallest hash).

    Rows that share an id and a text count as one, the one whose other columns are smallest; blank texts stay.
    """
    keys = ["__kept_d", "__kept_1", "__kept_2"]
    first = _classed(documents).filter(F.coalesce("root", "node") == F.col("node"))
    kept = first.select(F.col("rep").alias(keys[0]), F.col("k1").alias(keys[1]), F.col("k2").alias(keys[2]), F.lit(True).alias("__kept"))
    keyed = documents.withColumns(dict(zip(keys, (doc_key(F.col("doc_id")), *_hashes()))))
    rows = keyed.join(kept.hint("merge"), keys, "left").filter(F.col("__kept") | ~F.rlike(_text(), F.lit(WORD)))
    return rows.groupBy(*keys).agg(F.min(F.struct(*(documents[c] for c in documents.columns))).alias("row")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
c AS (SELECT text, any_value(w) AS w, min(doc_id) AS rep, count(*) AS copies FROM d WHERE len(w) > 0 GROUP BY text),
s AS (
  SELECT rep, copies, list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, chr(1))]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), chr(1))) END) AS g
  FROM c),
u AS (SELECT rep, unnest(g) AS x FROM s),
common AS (SELECT a.rep AS a, b.rep AS b, count(*) AS n FROM u a JOIN u b ON a.x = b.x AND a.rep <> b.rep GROUP BY ALL),
l AS (
  SELECT a, b, q.copies AS w FROM common JOIN s p ON p.rep = a JOIN s q ON q.rep = b
  WHERE n >= 0.8 * (len(p.g) + len(q.g) - n) - 1e-9),
reach AS (SELECT rep AS node, rep AS root FROM c UNION SELECT l.b, reach.root FROM reach JOIN l ON l.a = reach.node),
k AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
n AS (SELECT a, sum(w) AS links FROM l GROUP BY a)
SELECT d.doc_id, coalesce(k.root, d.doc_id) AS class_id, coalesce(c.rep, d.doc_id) AS copy_id,
  CAST(coalesce(c.copies - 1, 0) + coalesce(n.links, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN c ON c.text = d.text LEFT JOIN k ON k.node = c.rep LEFT JOIN n ON n.a = c.rep
"""
