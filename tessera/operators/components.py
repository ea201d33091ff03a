"""Strongly connected components of a distributed edge table.

Trimming drops edges that cannot lie on a cycle (an end without a way in or out). A strong component lies within a weak
one, so what is left is dealt to tasks by weak components, each of them whole, and solved there. Trimming and weak
components know nodes by a 64-bit hash: should two nodes share one, more edges stay or two weak components go to one task,
and the result is the same, as the tasks compare the ids. Hashes travel packed, many to a row: a half of a round keeps the
edges whose start is also an end (by some bits of its hash, which may keep more), part by part, and turns them round. Once few are left, one task trims them to the end
and finds their weak components; else that is done by joins.

Weak components too large for a task are coloured: every node takes the smallest id that reaches it. From each colour's
root the nodes of that colour that reach the root are walked backwards; they are the root's component. They go, edges
between colours go, and the rest starts anew. All snapshots are treated at once. Each step ends in a written table; only
counts come to the driver.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.lineage import cut, release
from tessera.operators.sieve import sieve

_TRIMS = 4
#: Edges of a snapshot that one task holds in memory without trouble.
ONE_TASK = 2_000_000
#: Edges that are worth another task: larger tables are trimmed and dealt out.
SHARE = 100_000
#: Edges, as hashes, of which one task finds the weak components.
HELD = 4_000_000
#: Rows of packed edges: a part of the nodes, the starts in it and the ends; ends alone stand in a, without b.
_PACKED = "p int, a binary, b binary"
#: The least number of parts, edges a part, edges packed at once, rounds of trimming in one task.
_PARTS, _PART, _PACK, _PEELS = 64, 1_000_000, 1_000_000, 50
#: Bits of a hash that trimming looks ends up by, in one part of them.
_SEEN = 24


def _trim(links: DataFrame) -> tuple[DataFrame, int]:
    """A few rounds of trimming, and the number of edges left. links is a written table, which is given back."""
    n = links.count()
    for _ in range(_TRIMS if n else 0):
        inner = links.join(links.select("s", F.col("u").alias("v")).distinct(), ["s", "v"], "left_semi").join(links.select("s", F.col("v").alias("u")).distinct(), ["s", "u"], "left_semi").select("s", "u", "v")
        links = cut(inner, links)
        before, n = n, links.count()
        if n in (0, before):
            break
    return links, n


def _colours(links: DataFrame) -> DataFrame:
    """s, x, c: the smallest node that reaches x. Only changed colours are sent on."""
    ends = links.select("s", F.explode(F.array("u", "v")).alias("x")).distinct()
    colour = cut(ends.select("s", "x", F.col("x").alias("c"), F.lit(True).alias("new")))
    while True:
        sent = colour.filter("new").select("s", F.col("x").alias("u"), "c").join(links, ["s", "u"]).groupBy("s", F.col("v").alias("x")).agg(F.min("c").alias("heard"))
        less = F.coalesce(F.col("heard") < F.col("c"), F.lit(False))
        colour = cut(colour.drop("new").join(sent, ["s", "x"], "left").select("s", "x", F.when(less, F.col("heard")).otherwise(F.col("c")).alias("c"), less.alias("new")), colour)
        if colour.filter("new").isEmpty():
            return colour


def _backwards(links: DataFrame, colour: DataFrame) -> DataFrame:
    """s, x, c: nodes that reach the root of their colour inside it."""
    of = lambda name: colour.select("s", F.col("x").alias(name), F.col("c").alias(f"c_{name}"))
    inside = cut(links.join(of("u"), ["s", "u"]).join(of("v"), ["s", "v"]).filter("c_u = c_v").select("s", "u", "v", F.col("c_u").alias("c")))
    start = cut(colour.filter("x = c").select("s", "x", "c").join(inside.select("s", F.col("v").alias("x")).distinct(), ["s", "x"], "left_semi"))
    # the nodes reached so far, and which of them are new
    reached = cut(start.withColumn("new", F.lit(True)), start)
    while True:
        back = reached.filter("new").select("s", F.col("x").alias("v"), "c").join(inside, ["s", "v", "c"]).select("s", F.col("u").alias("x"), "c", F.lit(True).alias("new"))
        known = reached.select("s", "x", "c", F.lit(False).alias("new"))
        reached = cut(known.unionByName(back).groupBy("s", "x", "c").agg(F.min("new").alias("new")), reached)
        if reached.filter("new").isEmpty():
            release(inside)
            return reached


def _one_task(pairs: pd.DataFrame) -> pd.DataFrame:
    """Components of edges u, v of one snapshot by depth-first search without recursion; those of several members or with a loop."""
    codes, names = pd.factorize(np.concatenate([pairs["u"].to_numpy(object), pairs["v"].to_numpy(object)]), sort=True)
    u, v = codes[: len(pairs)], codes[len(pairs) :]
    order = np.argsort(u, kind="stable")
    after, ends = v[order].tolist(), np.searchsorted(u[order], np.arange(len(names) + 1)).tolist()
    seen, low, open_, root = [0] * len(names), [0] * len(names), [], [-1] * len(names)
    clock = 0
    for top in range(len(names)):
        if seen[top]:
            continue
        work = [(top, ends[top])]
        clock += 1
        seen[top] = low[top] = clock
        open_.append(top)
        while work:
            x, i = work.pop()
            if i < ends[x + 1]:
                work.append((x, i + 1))
                y = after[i]
                if not seen[y]:
                    clock += 1
                    seen[y] = low[y] = clock
                    open_.append(y)
                    work.append((y, ends[y]))
                elif root[y] < 0:
                    low[x] = min(low[x], seen[y])
                continue
            if low[x] == seen[x]:
                at = len(open_) - 1
                while open_[at] != x:
                    at -= 1
                own = open_[at:]
                del open_[at:]
                least = min(own)
                for y in own:
                    root[y] = least
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[x])
    root = np.array(root, np.int64)
    keep = (np.bincount(root, minlength=len(names))[root] > 1) if len(names) else np.zeros(0, bool)
    keep[u[u == v]] = True
    return pd.DataFrame({"snapshot_id": pairs["s"].iloc[0], "cycle_root": names[root[keep]], "file_id": names[keep]})


def _part(x: np.ndarray, parts: int) -> np.ndarray:
    """In 16 bits where these do, as such are sorted by counting."""
    return ((x.view(np.uint64) >> np.uint64(20)) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int32)


def _distinct(x: np.ndarray) -> np.ndarray:
    """np.unique by sorting, which is many times faster than its hashing."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _seen(a: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of a are among ends, by the upper bits of these hashes: some others may pass too."""
    place = lambda x: x.view(np.uint64) >> np.uint64(64 - _SEEN)
    table = np.zeros(1 << _SEEN, bool)
    table[place(ends)] = True
    return table[place(a)]


def _blobs(a: np.ndarray, b: np.ndarray, parts: int) -> list[tuple]:
    """Rows of _PACKED with the edges a, b, one a part of a."""
    part = _part(a, parts)
    order = np.argsort(part, kind="stable")
    a, b, at = a[order], b[order], np.searchsorted(part[order], np.arange(parts + 1))
    return [(p, a[i:j].tobytes(), b[i:j].tobytes()) for p, (i, j) in enumerate(itertools.pairwise(at.tolist())) if j > i]


def _rows(rows: list[tuple]) -> pa.Table:
    p, a, b = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"p": pa.array(p, pa.int32()), "a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x is not None), np.int64)


def _pack(parts: int) -> Callable:
    """Edges hu, hv as blobs: by the part of their start, and their ends alone (b is null) by the ends' part."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append((batch["hu"].to_numpy(zero_copy_only=False), batch["hv"].to_numpy(zero_copy_only=False)))
                n += batch.num_rows
            if n and (batch is None or n >= _PACK):
                u, v = (np.concatenate(x) for x in zip(*held, strict=True))
                ends = _distinct(v)
                yield from _rows(_blobs(u, v, parts) + [(p, a, None) for p, a, _ in _blobs(ends, ends, parts)]).to_batches()
                held, n = [], 0

    return pack


def _peel(parts: int) -> Callable:
    """One half of a round of trimming in one part: edges a, b go unless a is also an end; the rest is turned round, for the other half."""

    def peel(rows: pa.Table) -> pa.Table:
        lone = pc.is_null(rows["b"])
        ends, rows = _numbers(rows.filter(lone)["a"]), rows.filter(pc.invert(lone))
        a, b = _numbers(rows["a"]), _numbers(rows["b"])
        found = _seen(a, ends)
        a, b = a[found], b[found]
        left = _distinct(a)
        return _rows(_blobs(b, a, parts) + [(p, x, None) for p, x, _ in _blobs(left, left, parts)])

    return peel


def _labelled(rows: pa.Table) -> pa.Table:
    """In one task: distinct edges hu, hv that trimming leaves in the end, and r, the smallest node of their weak component."""
    rows = rows.filter(pc.is_valid(rows["b"]))
    hu, hv = _numbers(rows["a"]), _numbers(rows["b"])
    names, codes = np.unique(np.concatenate([hu, hv]), return_inverse=True)
    u, v = codes[: len(hu)], codes[len(hu) :]
    pairs = _distinct(u * np.int64(len(names)) + v)
    u, v = (pairs // len(names), pairs % len(names)) if len(names) else (u, v)
    for _ in range(_PEELS):
        starts, ends = np.zeros(len(names), bool), np.zeros(len(names), bool)
        starts[u], ends[v] = True, True
        stay = ends[u] & starts[v]
        if stay.all():
            break
        u, v = u[stay], v[stay]
    root = np.arange(len(names))
    while True:
        # roots of the ends of an edge go to the smaller of them, then every node to its root's root
        x, y = root[u], root[v]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return pa.table({"hu": names[u], "hv": names[v], "r": names[root[u]]})


def _hashed(edge: DataFrame) -> DataFrame:
    return edge.withColumn("hu", F.xxhash64("s", "u")).withColumn("hv", F.xxhash64("s", "v"))


def _core(edge: DataFrame, few: int) -> DataFrame | None:
    """Rows s, u, v of edge that trimming leaves, and r, known by their weak component; none if edge has only a few rows."""
    n = edge.count()
    if n <= few:
        return None
    parts = max(_PARTS, math.ceil(n / _PART))
    links = _hashed(edge).select("hu", "hv").mapInArrow(_pack(parts), _PACKED)
    while True:
        for _ in range(4):
            links = links.groupBy("p").applyInArrow(_peel(parts), _PACKED)
        links = cut(links, links)
        before, n = n, links.filter("b IS NOT NULL").agg(F.coalesce(F.sum(F.octet_length("a")), F.lit(0))).first()[0] // 8
        if n <= HELD or n > before * 0.9:
            break
    labelled = "hu long, hv long, r long"
    if n <= HELD:
        left = cut(links.groupBy((F.col("p") < 0).alias("all")).applyInArrow(_labelled, labelled), links)
    else:
        left = cut(links.filter("b IS NOT NULL").mapInArrow(_unpack, "hu long, hv long").distinct(), links)
        weak = _weak(left)
        left = cut(left.join(weak, left["hu"] == weak["x"], "left").select("hu", "hv", F.coalesce("r", "hu").alias("r")), left, weak)
    return cut(sieve(_hashed(edge), F.xxhash64("hu", "hv"), left.select(F.xxhash64("hu", "hv"))).join(left, ["hu", "hv"]).select("s", "u", "v", "r"), left)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        yield from pa.table({"hu": _numbers(rows["a"]), "hv": _numbers(rows["b"])}).to_batches()


def _weak(links: DataFrame) -> DataFrame:
    """x, r: the smallest node of x's weak component, for all x but these; by large and small stars in turn. links: hu, hv."""
    star = cut(links.filter("hu <> hv").select(F.greatest("hu", "hv").alias("x"), F.least("hu", "hv").alias("r")).distinct())
    seen = None
    while True:
        now = star.agg(F.count("*"), F.sum(F.xxhash64("x", "r").cast("decimal(38,0)"))).first()
        if now == seen:
            return star
        seen = now
        # every larger neighbour of x goes to the smallest node among x and its neighbours
        both = star.unionByName(star.select(F.col("r").alias("x"), F.col("x").alias("r")))
        least = both.groupBy("x").agg(F.min("r").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = cut(both.filter("r > x").join(least, "x").select(F.col("r").alias("x"), F.col("m").alias("r")).distinct(), star)
        # x and its smaller neighbours go to the smallest of them
        least = large.groupBy("x").agg(F.min("r").alias("m"))
        rest = large.join(least, "x").filter("r <> m").select(F.col("r").alias("x"), F.col("m").alias("r"))
        star = cut(least.select("x", F.col("m").alias("r")).unionByName(rest).distinct(), large)


def strong_components(edge: DataFrame, one_task: int = ONE_TASK, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """cycle members of edges (snapshot_id, source, target), repeated or not: snapshot_id, cycle_root (the smallest member), file_id.

    A component counts if it has several members or an edge to itself. Few edges are solved by snapshot; of many, what
    trimming leaves is solved by weak components; those of more than `one_task` edges by colouring. All ways give the same
    rows. `keep` filters the edges, whatever other columns they have; it is given only those that trimming leaves.
    """
    share = min(one_task, SHARE)
    every = edge.select(F.col("snapshot_id").alias("s"), F.col("source").alias("u"), F.col("target").alias("v"))
    core = _core(every, share)
    edge = every if core is None else core
    if keep:
        kept = keep(edge.withColumnsRenamed({"s": "snapshot_id", "u": "source", "v": "target"}))
        edge = kept.withColumnsRenamed({"snapshot_id": "s", "source": "u", "target": "v"})
    solved = lambda rows, *key: rows.groupBy(*key).applyInPandas(_one_task, "snapshot_id string, cycle_root string, file_id string")
    if core is None:
        return solved(edge.distinct(), "s")
    edge = cut(edge.distinct(), core)
    heavy = cut(edge.groupBy("r").count().filter(F.col("count") > one_task).select("r"))
    tasks = math.ceil(edge.count() / share)
    if not tasks:
        return solved(edge, "s")
    found = solved(edge.join(heavy, "r", "left_anti").withColumn("task", F.pmod(F.xxhash64("r"), F.lit(tasks))), "s", "task")
    if heavy.isEmpty():
        return found
    return found.unionByName(coloured(edge.join(heavy, "r", "left_semi").select(F.col("s").alias("snapshot_id"), F.col("u").alias("source"), F.col("v").alias("target"))))


def coloured(edge: DataFrame) -> DataFrame:
    """strong_components by trimming and colouring alone."""
    pairs = cut(edge.select(F.col("snapshot_id").alias("s"), F.col("source").alias("u"), F.col("target").alias("v")).distinct())
    loops = pairs.filter("u = v").select("s", F.col("u").alias("x"), F.col("u").alias("c"))
    links, n = _trim(cut(pairs.filter("u <> v")))
    found = None
    while n:
        colour = _colours(links)
        members = _backwards(links, colour)
        several = members.join(members.groupBy("s", "c").count().filter("count > 1").select("s", "c"), ["s", "c"], "left_semi").select("s", "x", "c")
        found = several if found is None else found.unionByName(several)
        of = lambda name: colour.join(members.select("s", "x"), ["s", "x"], "left_anti").select("s", F.col("x").alias(name), F.col("c").alias(f"c_{name}"))
        rest = cut(links.join(of("u"), ["s", "u"]).join(of("v"), ["s", "v"]).filter("c_u = c_v").select("s", "u", "v"), links)
        release(colour)
        links, n = _trim(rest)
    every = loops if found is None else found.unionByName(loops.join(found, ["s", "x"], "left_anti"))
    return every.select(F.col("s").alias("snapshot_id"), F.col("c").alias("cycle_root"), F.col("x").alias("file_id"))


def cycles(members: DataFrame) -> DataFrame:
    """One row a cycle: its sorted members, and its place among the snapshot's cycles."""
    rows = members.groupBy("snapshot_id", "cycle_root").agg(F.array_sort(F.collect_list("file_id")).alias("members"))
    return rows.withColumn("place", (F.row_number().over(Window.partitionBy("snapshot_id").orderBy("cycle_root")) - 1).cast("long"))
