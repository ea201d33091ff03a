"""What the corpus operators share: tables, and the words of texts as numpy arrays."""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.lineage import cut

__all__ = ["U", "WORD", "Words", "byte_hash", "cut", "doc_key", "joined", "mix", "pieces", "settle", "table", "tidy", "utf8"]

#: A word is a maximal run of characters other than these six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True

#: Text bytes handled at once in a Python worker; a longer single text is handled alone.
CHUNK_BYTES = 500_000

U = np.uint64
_SEED = {1: 0x9E3779B97F4A7C15, 2: 0xD1342543DE82EF95, 3: 0xA0761D6478BD642F}


def settle(spark: SparkSession) -> None:
    """Texts go to Python in small batches, so that long ones don't fill a worker; a setting of the user's stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    settle(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_key(doc_id: Column) -> Column:
    """Null ids come first, as one key before all others."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(2**63)))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every input bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: Bytes up to which a range is hashed eight bytes at a time; longer ones go through BLAKE2b.
_CHAINED = 256


def byte_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """64 bits of each byte range: its length and its blocks of eight bytes, chained through a mixing bijection.

    Not linear in the bytes, so different seeds (which) make different collisions; up to eight bytes there are none.
    """
    length = ends - starts
    h = mix(length.astype(U) * U(0x9E3779B97F4A7C15) + U(_SEED[which]))
    long = np.flatnonzero(length > _CHAINED)
    for i in long.tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=bytes([which])).digest(), "little")
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    blocks = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))
    at = np.flatnonzero((length > 0) & (length <= _CHAINED))
    done = 0
    while len(at):
        left = length[at] - done
        block = blocks[starts[at] + done]
        spare = np.maximum(8 - left, 0).astype(U) * U(8)
        h[at] = mix(h[at] ^ (block << spare))
        done += 8
        at = at[left > 8]
    return h


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of two neighbours to one."""
    return mix(left * U(0xD1342543DE82EF95) + right)


def neighbour_hash(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k neighbouring values, by doubling."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out, done, power, size = None, 0, values, 1
    while done < k:
        if k & size:
            out = power if out is None else joined(out[: len(power) - done], power[done:])
            done += size
        if done < k:
            power = joined(power[:-size], power[size:])
            size *= 2
    return out[:n]


class Words:
    """The words of several UTF-8 texts laid end to end, as arrays.

    data: the bytes; starts, ends: each word's byte range; counts: words per text;
    first: index of each text's first word; text: index of each word's text; hash(which): 64 bits a word;
    digests(begin, count): 128 bits of the words themselves.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        blank = _BLANK[data]
        n = len(data)
        before, after = np.ones(n, bool), np.ones(n, bool)
        if n:
            before[1:], after[:-1] = blank[:-1], blank[1:]
            inner = offsets[(offsets > 0) & (offsets < n)]
            before[inner] = True
            after[inner - 1] = True
        self.data = data
        self.starts = np.flatnonzero(~blank & before)
        self.ends = np.flatnonzero(~blank & after) + 1
        edges = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(edges)
        self.first = edges[:-1]
        self.text = np.repeat(np.arange(len(self.counts)), self.counts)
        self._hash: dict[int, np.ndarray] = {}
        self._line: tuple[np.ndarray, np.ndarray] | None = None

    def hash(self, which: int = 1) -> np.ndarray:
        if which not in self._hash:
            self._hash[which] = byte_hash(self.data, self.starts, self.ends, which)
        return self._hash[which]

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word of every window of k words inside one text, and the number of windows per text."""
        per = np.maximum(self.counts - k + 1, 0)
        if not per.sum():
            return np.zeros(0, np.int64), per
        return np.repeat(self.first - np.concatenate([[0], np.cumsum(per)[:-1]]), per) + np.arange(per.sum()), per

    def window_hash(self, begin: np.ndarray, k: int, which: int = 1) -> np.ndarray:
        """Hash of the k words from each of begin on."""
        return self.every(k, which)[begin]

    def every(self, k: int, which: int = 1) -> np.ndarray:
        """Hash of any k neighbouring words, also across texts."""
        return neighbour_hash(self.hash(which), k)

    def digests(self, begin: np.ndarray, count: np.ndarray | int) -> np.ndarray:
        """BLAKE2b of the count words from each of begin on, inside one text and joined by single blanks: two numbers each."""
        size = self.ends - self.starts
        if self._line is None:
            gap = np.zeros(len(size), bool)
            inner = self.ends < len(self.data)
            gap[inner] = _BLANK[self.data[self.ends[inner]]]
            keep = ~_BLANK[self.data]
            keep[self.ends[gap]] = True
            line = self.data[keep]
            line[_BLANK[line]] = 32
            self._line = line, np.cumsum(size + gap) - size - gap
        line, at = self._line
        last = begin + count - 1
        view, out = memoryview(line), np.empty((len(begin), 2), np.int64)
        for lo in range(0, len(begin), 65_536):
            hi = min(lo + 65_536, len(begin))
            ends = at[last[lo:hi]] + size[last[lo:hi]]
            raw = b"".join(hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(at[begin[lo:hi]].tolist(), ends.tolist()))
            out[lo:hi] = np.frombuffer(raw, "<i8").reshape(-1, 2)
        return out


def tidy() -> None:
    """Gives freed memory back to the system: a Python worker outlives its tasks, and an executor's memory is shared."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # only in the GNU library
        pass


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about limit bytes of text."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi
    tidy()
