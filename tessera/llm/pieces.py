"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is parsed here (pieces with scores and kinds, trainer and normaliser settings), and the same
tokenizer is rebuilt from tokenizers' parts: the precompiled character map where there is one, the metaspace marker,
the model (unigram with its scores; byte-pair merges ranked by their piece's score for models of that kind), and byte
fallback. Pieces never join text across certain cuts (see Codec.cuts), so a text is cut there, every distinct segment
is encoded once, in multithreaded batches, and ids are put together by array lookups.

Parity: every distinct segment is decoded again and compared with itself (`round_trip` of a text: all its segments),
and encoded by the sentencepiece library and compared with its ids (`parity`); tests compare whole texts as well. Where
a normaliser changes texts, the round trip is that of the normalised text.

Defined results: null text is empty and has no ids; repeated rows give equal values; an empty table gives no rows; a
text is handled whole; other columns are ignored. Spans the model cannot represent even as bytes become its unknown id.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import operator
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import pieces as cut_batches
from tessera.llm.common import table, tidy, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Distinct segments a worker remembers, the first it meets, which are the frequent ones; others it knows for a batch.
REMEMBERED = 350_000
#: Segments encoded at once.
SLICE = 20_000
#: Text bytes cut into segments at once: the more, the fewer lookups of frequent segments.
BATCH_BYTES = 4_000_000
#: Threads with which a worker encodes its batches.
THREADS = 2
MARK = "▁"
# fixed values of the format: kinds of pieces, kinds of models
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protobuf message: numbers, or bytes for lengths and fixed widths."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """What a model file says."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.unk_id = UNIGRAM, 0
        self.charsmap, self.prefix, self.squeeze, self.escape, self.fallback, self.suffix = b"", True, True, True, False, False
        for field, value in _fields(data):
            if field == 1:
                piece, score, kind = "", 0.0, NORMAL
                for f, v in _fields(value):
                    if f == 1:
                        piece = v.decode()
                    elif f == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif f == 3:
                        kind = v
                self.pieces.append((piece, score, kind))
            elif field == 2:
                spec = dict(_fields(value))
                self.kind, self.fallback, self.suffix = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), bool(spec.get(24, 0))
            elif field == 3:
                spec = dict(_fields(value))
                self.charsmap, self.prefix, self.squeeze, self.escape = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        self.unk_id = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)


class Codec:
    """Encodes and decodes as the model file's own library does."""

    def __init__(self, model: Model, data: bytes):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        if model.kind not in (UNIGRAM, BPE) or model.suffix or not model.escape:
            raise ValueError("unigram and byte-pair models with a leading marker are read")
        self.model = model
        ids = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        if model.kind == BPE:
            usable = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER)}
            merges = [(-usable[p], i, p[:j], p[j:]) for i, (p, _, kind) in enumerate(model.pieces) if kind == NORMAL for j in range(1, len(p)) if p[:j] in usable and p[j:] in usable]
            merges.sort(key=lambda m: (m[0], m[1], ids[m[2]], ids[m[3]]))
            core = models.BPE(ids, [(a, b) for _, _, a, b in merges], unk_token=model.pieces[model.unk_id][0], fuse_unk=True, byte_fallback=model.fallback)
        else:
            core = models.Unigram([(p, s if kind != CONTROL else -1e9) for p, s, kind in model.pieces], unk_id=model.unk_id, byte_fallback=model.fallback)
        self.tokenizer = Tokenizer(core)
        steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
        if model.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        self.normal = normalizers.Sequence(steps) if steps else None
        self.tokenizer.normalizer = normalizers.Replace(" ", MARK)
        self.tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        whole = [p for p, _, kind in model.pieces if kind in (NORMAL, USER)]
        # Byte-pair pieces with a marker after other characters would join across a blank; then texts stay whole.
        self.cuts = model.kind == BPE and not any(MARK in p.lstrip(MARK) for p in whole)
        # Control blanks that no piece holds are bytes of their own.
        self.lone = np.zeros(256, bool)
        self.lone[[c for c in (9, 10, 11, 12, 13) if not any(chr(c) in p for p in whole)]] = True
        self.other = SentencePieceProcessor(model_proto=data)
        self.known: dict[bytes, int] = {}
        self.forget()

    def normalise(self, text: str) -> str:
        """What the model encodes, without the added prefix."""
        return self.normal.normalize_str(text) if self.normal else text

    def _segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where segments start, and each text's number of them."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
        first = offsets[:-1][np.diff(offsets) > 0]
        start = np.zeros(len(data), bool)
        if self.cuts:
            blank, lone = data == 32, self.lone[data]
            start[1:] = (blank[1:] & ~blank[:-1]) | (lone[1:] != lone[:-1])
        start[first] = True
        at = np.flatnonzero(start)
        return at, np.diff(np.searchsorted(at, offsets))

    def _theirs(self, texts: list[str]) -> list[list[int]]:
        """The library's ids of the segments. Behind a line feed, which is a byte of its own, no marker is added."""
        if not self.cuts:
            return self.other.encode([t[1:] if self.model.prefix and t[:1] == " " else t for t in texts], num_threads=1)
        head = len(self.other.encode("\n"))
        return [ids[head:] for ids in self.other.encode(["\n" + t for t in texts], num_threads=1)]

    def forget(self) -> None:
        """Known segments: a slot each, whose ids are flat[begin:begin + size]; faults: doesn't decode to itself, the library disagrees."""
        self.known.clear()
        self.passing: list[bytes] = []
        self.flat, self.size, self.faults = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros((0, 2), bool)

    def slots(self, segments: list[bytes]) -> np.ndarray:
        """The slot of each segment until the next call (blanks at its start are markers); new ones are encoded, decoded again and compared."""
        for s in self.passing:
            del self.known[s]
        known, kept = self.known, len(self.known)
        self.flat, self.size, self.faults = self.flat[: self.size[:kept].sum()], self.size[:kept], self.faults[:kept]
        new = list(dict.fromkeys(s for s in segments if s not in known))
        self.passing = new[max(0, REMEMBERED - kept) :]
        for lo in range(0, len(new), SLICE):  # some at a time: ids are Python integers here
            some = new[lo : lo + SLICE]
            texts = [s.decode("utf-8", "replace") for s in some]
            made = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            back = self.tokenizer.decode_batch(made, skip_special_tokens=False)
            wrong = np.fromiter(map(operator.ne, texts, back), bool, len(some)), np.fromiter(map(operator.ne, made, self._theirs(texts)), bool, len(some))
            known.update(zip(some, range(len(known), len(known) + len(some))))
            size = np.fromiter(map(len, made), np.int64, len(made))
            self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(made), np.int32, int(size.sum()))])
            self.size = np.concatenate([self.size, size])
            self.faults = np.concatenate([self.faults, np.stack(wrong, axis=1)])
        return np.fromiter(map(known.__getitem__, segments), np.int64, len(segments))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts laid end to end, each text's number of ids, whether it decodes to itself, whether the library agrees."""
        if self.normal:
            texts = [self.normalise(data[a:b].tobytes().decode("utf-8", "replace")).encode() for a, b in zip(offsets[:-1], offsets[1:])]
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            data = np.frombuffer(b"".join(texts), np.uint8)
        at, per = self._segments(data, offsets)
        n = len(at)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64), *(np.ones(len(offsets) - 1, bool) for _ in range(2))
        bounds = np.append(at, len(data))
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = column.dictionary_encode()
        index, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
        if self.model.prefix:  # a text's first segment begins with the added marker
            heads = (np.cumsum(per) - per)[per > 0]
            own = [b" " + names[i] for i in index[heads]]
            index[heads] = len(names) + np.arange(len(heads))
            names += own
        index = self.slots(names)[index]
        begin, many = np.cumsum(self.size) - self.size, self.size[index]
        total = np.cumsum(many)
        ids = self.flat[np.repeat(begin[index] - (total - many), many) + np.arange(total[-1])]
        edge = np.cumsum(per)
        ends = np.append(0, total)[edge]
        wrong = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(self.faults[index], axis=0)])[edge]
        fine = np.diff(wrong, axis=0, prepend=0) == 0
        return ids, np.diff(np.append(0, ends)), fine[:, 0], fine[:, 1]

    def decode(self, ids: np.ndarray) -> str:
        """The text of one text's ids (normalised text, without the added marker)."""
        text = self.tokenizer.decode([int(i) for i in ids], skip_special_tokens=False)
        return text[1:] if self.model.prefix and text.startswith(" ") else text


@functools.lru_cache(2)
def codec(model_bytes: bytes) -> Codec:
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
    return Codec(Model(model_bytes), model_bytes)


def _encode(model_bytes: bytes, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_bytes)
        for batch in cut_batches(batches, limit=BATCH_BYTES):
            column = batch.column(batch.schema.get_field_index("text"))
            ids, counts, same, agreed = own.encode(*utf8(column))
            ends = np.cumsum(counts)
            raw = ids.astype("<i4", copy=False)
            digests = [hashlib.sha256(raw[e - n : e]).hexdigest() for n, e in zip(counts, ends)]
            rest = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            extra = [pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(raw))] if with_ids else []
            yield pa.RecordBatch.from_arrays([*rest, pa.array(counts, pa.int64()), pa.array(digests), pa.array(same), pa.array(agreed), *extra], names=[*names, "n_tokens", "ids_sha256", "round_trip", "parity", *["ids"][: len(extra)]])
        own.forget()
        tidy()

    return run


def encode_documents(documents: DataFrame, model_path: str = MODEL, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers), round_trip (decoding gives the text), parity (the library gives these ids), and the ids on request."""
    with open(model_path, "rb") as f:
        data = f.read()
    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_encode(data, with_ids), "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean, parity boolean" + ", ids array<int>" * with_ids)


def _decode(model_bytes: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_bytes)
        for batch in batches:
            texts = [own.decode(ids.values.to_numpy(zero_copy_only=False)) if ids.is_valid else None for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode_documents(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id and text of encode_documents' ids."""
    with open(model_path, "rb") as f:
        data = f.read()
    return encoded.select("doc_id", "ids").mapInArrow(_decode(data), "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), with_ids=False)


SQL = None
