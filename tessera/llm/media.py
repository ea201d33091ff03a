"""Media columns: payloads kept losslessly in progressive JPEG streams, and decoded to RGB tensors.

The format's unit is the quantised DCT coefficient. A payload is padded with zero bytes to a positive multiple of 64;
every 64 bytes are the coefficients of one 8x8 block in zigzag order. Blocks fill the planes of a 4:2:0 picture
(luminance first, then the two chroma planes), spare blocks are zero. The DC coefficient is the byte itself; an AC
coefficient has the magnitude 128 + (byte mod 128) and the sign of the top bit, so each is significant from the first
scan on. The stream is progressive: spectral selection parts DC and AC scans, successive approximation sends the DC in
one first scan and eight refinements, the AC in one first scan and seven refinements.

The reader accumulates whatever scans it finds into coefficient arrays. Scans of the shape written here are read as
bit planes with numpy; other scans of Huffman-coded progressive pictures (three components in 4:2:0 or unsampled, any
tables, restart intervals) go through a bit-by-bit reader of the same standard; what is neither raises ValueError.
The coefficients are inverse-transformed in numpy with an integer basis (sums stay exact in doubles, so equal streams
give equal pixels), chroma is upsampled by repetition, and the RGB tensor, which `load` stores beside the payload, has
the picture's full resolution.

Defined results: null text is empty; the empty text is one block of zeros; repeated rows give equal values; an empty
table gives no rows; other columns are ignored. A text is handled whole, one at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, utf8

UNIT = 64
#: Fixed values of the format: zigzag order as (row, column) by diagonals.
_DIAG = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
_SHIFT = 13


def _basis() -> np.ndarray:
    """Row k: the pixels of zigzag coefficient k, times 2**13, as whole numbers."""
    i = np.arange(8)
    one = np.cos((2 * i[None, :] + 1) * i[:, None] * np.pi / 16) * np.where(i == 0, np.sqrt(0.125), 0.5)[:, None]
    return np.array([np.rint(np.outer(one[r], one[c]) * 2**_SHIFT).ravel() for r, c in _DIAG])


_IDCT = _basis()
#: Most blocks an end-of-band run of the writer covers: a multiple of 8 keeps every header at a byte.
_RUN = 32760
_TALL = 4095
#: Units that are inverse-transformed at once.
_STRIP = 4096


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


_TABLES = (
    _segment(0xDB, bytes([0]) + bytes([1] * 64))
    + _segment(0xC4, bytes([0x00, 1] + [0] * 15 + [0]))  # DC: one code of one bit for category 0
    + _segment(0xC4, bytes([0x10] + [1] * 16 + [0x01] + [r << 4 for r in range(14, -1, -1)]))  # AC: run codes of 16 - r bits, then r bits
)


def _scan(components: list[int], ss: int, se: int, ah: int, al: int) -> bytes:
    return _segment(0xDA, bytes([len(components)] + [x for c in components for x in (c, 0x00)] + [ss, se, ah << 4 | al]))


def _bits(bits: np.ndarray, head: bytes = b"") -> bytes:
    """Entropy-coded bytes: filled up with ones, 0xFF stuffed."""
    spare = -len(bits) % 8
    if spare:
        bits = np.concatenate([bits, np.ones(spare, np.uint8)])
    return (head + np.packbits(bits).tobytes()).replace(b"\xff", b"\xff\x00")


def _run_head(n: int) -> bytes:
    r = n.bit_length() - 1
    return ((((1 << (16 - r)) - 2) << r) | (n - (1 << r))).to_bytes(2, "big")


def _layout(blocks: int) -> tuple[int, int]:
    """Rows and columns of 16x16 units for so many payload blocks."""
    units = -(-blocks // 6)
    cols = -(-units // _TALL)
    return -(-units // cols), cols


def _units(rows: int, cols: int) -> np.ndarray:
    """For each unit its four luminance blocks, as indices in raster order."""
    raster = np.arange(4 * rows * cols).reshape(2 * rows, 2 * cols)
    return raster.reshape(rows, 2, cols, 2).transpose(0, 2, 1, 3).reshape(-1, 4)


def encode(payload: bytes) -> bytes:
    """A payload of a positive multiple of 64 bytes as a progressive JPEG stream."""
    if not payload or len(payload) % UNIT:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    rows, cols = _layout(len(payload) // UNIT)
    m = rows * cols
    v = np.zeros((6 * m, UNIT), np.uint8)
    v.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    planes = v[: 4 * m], v[4 * m : 5 * m], v[5 * m :]
    out = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), _TABLES]
    out.append(_segment(0xC2, bytes([8]) + (16 * rows).to_bytes(2, "big") + (16 * cols).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    dc = np.concatenate([planes[0][:, 0][_units(rows, cols)], planes[1][:, :1], planes[2][:, :1]], axis=1).ravel()
    out += [_scan([1, 2, 3], 0, 0, 0, 8), _bits(np.zeros(6 * m, np.uint8))]
    for al in range(7, -1, -1):
        out += [_scan([1, 2, 3], 0, 0, al + 1, al), _bits(dc >> al & 1)]
    for c, plane in enumerate(planes, 1):
        ac = plane[:, 1:].reshape(-1)
        first = np.zeros(2 * len(ac), np.uint8)
        first[1::2] = ac >> 7
        out += [_scan([c], 1, 63, 0, 7), _bits(first)]
        for al in range(6, -1, -1):
            out.append(_scan([c], 1, 63, al + 1, al))
            bits = ac >> al & 1
            for lo in range(0, len(plane), _RUN):
                n = min(_RUN, len(plane) - lo)
                out.append(_bits(bits[lo * 63 : (lo + n) * 63], _run_head(n)))
    return b"".join([*out, b"\xff\xd9"])


class _Bits:
    """Reads an unstuffed scan bit by bit, most significant first."""

    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0

    def take(self, n: int) -> int:
        value = 0
        for _ in range(n):
            value = value << 1 | int(self.bits[self.at])
            self.at += 1
        return value

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("no such Huffman code")

    def signed(self, size: int) -> int:
        v = self.take(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def _scan_slowly(data: bytes, targets: list[tuple[np.ndarray, list[np.ndarray], dict, dict]], ss: int, se: int, ah: int, al: int) -> None:
    """Any part of a progressive scan between restarts. targets: coefficients, block order by unit, DC codes, AC codes."""
    bits = _Bits(data)
    if ss == 0:
        last = [0] * len(targets)
        for u in range(len(targets[0][1])):
            for t, (coef, order, dc, _) in enumerate(targets):
                for b in order[u]:
                    if ah:
                        coef[b, 0] |= bits.take(1) << al
                    else:
                        last[t] += bits.signed(bits.symbol(dc))
                        coef[b, 0] = last[t] << al
        return
    coef, order, _, ac = targets[0]
    run, one = 0, 1 << al
    for b in (int(x) for unit in order for x in unit):
        k = ss

        def correct(i: int, block: int = b) -> None:
            if bits.take(1) and not abs(int(coef[block, i])) & one:
                coef[block, i] += one if coef[block, i] > 0 else -one

        if not run:
            while k <= se:
                r, size = divmod(bits.symbol(ac), 16)
                if not size and r < 15:
                    run = (1 << r) + bits.take(r)
                    break
                value = (bits.signed(size) << al) if not ah else (one if bits.take(1) else -one) if size else 0
                while k <= se:
                    if ah and coef[b, k]:
                        correct(k)
                    elif r:
                        r -= 1
                    else:
                        break
                    k += 1
                if k <= se and value:
                    coef[b, k] = value
                k += 1
        if run:
            if ah:
                for i in range(k, se + 1):
                    if coef[b, i]:
                        correct(i)
            run -= 1


#: The end of a scan's data, and restarts inside.
_NEXT, _RESTART = re.compile(rb"\xff[^\x00\xd0-\xd7]", re.S), re.compile(rb"\xff[\xd0-\xd7]")
_DC_ONE, _AC_OWN = {(1, 0): 0}, {(1, 0): 1} | {(16 - r, (1 << (16 - r)) - 2): r << 4 for r in range(15)}


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    code, out, at = 0, {}, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _planes_of_bits(data: bytes, blocks: int) -> np.ndarray | None:
    """The correction bits of a refinement whose end-of-band runs cover all blocks; None if the scan is another."""
    found, at = [], 0
    while blocks:
        head = int.from_bytes(data[at : at + 2], "big")
        length = 1
        while length < 17 and head >> (16 - length) & 1:
            length += 1
        r = 16 - length
        if length < 2 or r < 0:
            return None
        n = (1 << r) + (head & ((1 << r) - 1))
        if n > blocks or (n < blocks and n * 63 % 8):
            return None
        size = -(-n * 63 // 8)
        if len(data) < at + 2 + size:
            return None
        found.append(np.unpackbits(np.frombuffer(data, np.uint8, size, at + 2))[: n * 63])
        at, blocks = at + 2 + size, blocks - n
    return found[0] if len(found) == 1 else np.concatenate(found)


class Picture:
    """A decoded stream: height, width, coefficient planes (blocks by 64, zigzag), comment."""

    def __init__(self, stream: bytes, slowly: bool = False):
        self.comment, self.coef, self.tables, self.restart = b"", [], {}, 0
        codes: dict[int, dict] = {}
        at = 2
        while True:
            marker = stream[at + 1]
            if marker == 0xD9:
                break
            size = int.from_bytes(stream[at + 2 : at + 4], "big")
            body, at = stream[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    codes[body[0]] = _codes(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.tables[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                    body = body[65 + 64 * wide :]
            elif marker == 0xDD:
                self.restart = int.from_bytes(body, "big")
            elif marker == 0xC2:
                self._frame(body)
            elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
                raise ValueError("only Huffman-coded progressive pictures are read")
            elif marker == 0xDA:
                end = _NEXT.search(stream, at).start()
                self._scan(stream[at:end], body, codes, slowly)
                at = end
        self.payload_bytes = int(self.comment.split()[1]) if self.comment.startswith(b"payload ") else 0

    def _frame(self, body: bytes) -> None:
        """Size, sampling and quantisation tables of the components, and empty coefficient planes of whole units."""
        self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        parts = [body[6 + 3 * i : 9 + 3 * i] for i in range(body[5])]
        self.names, self.quant = [p[0] for p in parts], [p[2] for p in parts]
        sampling = bytes(p[1] for p in parts)
        if body[0] != 8 or sampling not in (b"\x22\x11\x11", b"\x11\x11\x11"):
            raise ValueError("pictures of three components of 8 bits are read, in 4:2:0 or unsampled")
        self.step = sampling[0] >> 4
        side = 8 * self.step
        self.rows, self.cols = -(-self.height // side), -(-self.width // side)
        m = self.rows * self.cols
        self.coef = [np.zeros((n, 64), np.int16) for n in (self.step**2 * m, m, m)]
        self.units = _units(self.rows, self.cols) if self.step == 2 else np.arange(m)[:, None]

    def _alone(self, c: int) -> list[list[int]]:
        """The blocks of a scan of one component: those that hold pixels, row by row."""
        part = self.step if c == 0 else 1
        wide, high = ((-(-x * part // (8 * self.step))) for x in (self.width, self.height))
        return (np.arange(high)[:, None] * (part * self.cols) + np.arange(wide)).reshape(-1, 1).tolist()

    def _scan(self, raw: bytes, head: bytes, codes: dict, slowly: bool) -> None:
        which = [self.names.index(head[1 + 2 * i]) for i in range(head[0])]
        picked = [head[2 + 2 * i] for i in range(head[0])]
        ss, se, ah, al = head[-3], head[-2], head[-1] >> 4, head[-1] & 15
        dc, ac = [codes.get(t >> 4, {}) for t in picked], [codes.get(0x10 | t & 15, {}) for t in picked]
        n, data = len(self.coef[which[0]]), raw.replace(b"\xff\x00", b"\xff")
        plain = not slowly and not self.restart and self.step == 2
        if plain and ss == 0 and which == [0, 1, 2] and (ah or all(d == _DC_ONE for d in dc)):
            if ah:
                m = len(self.units)
                bits = np.unpackbits(np.frombuffer(data, np.uint8))[: 6 * m].reshape(m, 6).astype(np.int16) << al
                self.coef[0][self.units, 0] |= bits[:, :4]
                self.coef[1][:, 0] |= bits[:, 4]
                self.coef[2][:, 0] |= bits[:, 5]
            return
        orders = [self.units.tolist() if c == 0 else [[i] for i in range(len(self.coef[c]))] for c in which] if len(which) > 1 else [self._alone(which[0])]
        if plain and (ss, se) == (1, 63) and ac[0] == _AC_OWN and len(orders[0]) == n:
            band = self.coef[which[0]][:, 1:]
            if not ah:
                bits = np.unpackbits(np.frombuffer(data, np.uint8))[: 126 * n]
                if len(bits) == 126 * n and not bits[0::2].any():
                    band[:] = (bits[1::2].astype(np.int16).reshape(n, 63) * 2 - 1) << al
                    return
            elif (bits := _planes_of_bits(data, n)) is not None and band.all():
                band += np.sign(band) * (bits.reshape(n, 63).astype(np.int16) << al)
                return
        every = self.restart or len(orders[0])
        for i, part in enumerate(_RESTART.split(raw) if self.restart else [raw]):
            own = [order[i * every : (i + 1) * every] for order in orders]
            _scan_slowly(part.replace(b"\xff\x00", b"\xff"), [(self.coef[c], o, d, a) for c, o, d, a in zip(which, own, dc, ac)], ss, se, ah, al)

    def payload(self) -> bytes:
        """The bytes that encode() was given."""
        coef = np.concatenate(self.coef) if len(self.coef[1]) else self.coef[0]
        out = (np.abs(coef) & 127 | np.where(coef > 0, 128, 0)).astype(np.uint8)
        out[:, 0] = coef[:, 0]
        return out.tobytes()[: self.payload_bytes]

    def rgb(self) -> np.ndarray:
        """The tensor (height, width, 3) of bytes, made some rows of units at a time."""
        side = 8 * self.step
        out = np.empty((side * self.rows, side * self.cols, 3), np.uint8)
        some = max(1, _STRIP // max(1, self.cols))
        for lo in range(0, self.rows, some):
            hi = min(self.rows, lo + some)
            out[side * lo : side * hi] = self._strip(lo, hi)
        return out[: self.height, : self.width]

    def _strip(self, lo: int, hi: int) -> np.ndarray:
        full = []
        for i, coef in enumerate(self.coef):
            times = self.step if i == 0 else 1
            r, c = times * (hi - lo), times * self.cols
            part = coef[times * lo * c : times * hi * c]
            pixels = ((part * self.tables[self.quant[i]]).astype(np.float64) @ _IDCT).astype(np.int64)
            plane = np.clip((pixels + (1 << (_SHIFT - 1)) >> _SHIFT) + 128, 0, 255).astype(np.int32)
            plane = plane.reshape(r, c, 8, 8).swapaxes(1, 2).reshape(8 * r, 8 * c)
            full.append(plane if i == 0 else plane.repeat(self.step, 0).repeat(self.step, 1) - 128)
        y, cb, cr = full
        # fixed values: the ITU-R BT.601 weights times 2**16
        rgb = np.stack([y + (91881 * cr + 32768 >> 16), y - (22554 * cb + 46802 * cr + 32768 >> 16), y + (116130 * cb + 32768 >> 16)], axis=-1)
        return np.clip(rgb, 0, 255).astype(np.uint8)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = utf8(batch.column(1))
        media, held, size = [], 0, 0
        for i in range(batch.num_rows):
            text = raw[offsets[i] : offsets[i + 1]].tobytes()
            media.append(encode(text + bytes(-len(text) % UNIT or (0 if text else UNIT))))
            size += len(media[-1])
            if size > 8 << 20 or i == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(held, len(media)), pa.array(np.diff(offsets)[held : i + 1]), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])
                media, held, size = [], i + 1, 0


def store(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text as UTF-8) and the JPEG stream `media` that holds the padded text."""
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def _load(tensors: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                piece = batch.slice(lo, 256)
                payloads, features, shapes, made = [], [], [], []
                for stream in piece.column(2):
                    p = Picture(stream.as_buffer().to_pybytes())
                    rgb = p.rgb()
                    payloads.append(p.payload())
                    sums = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64)
                    features.append(f"{p.height}x{p.width}x3 " + " ".join(f"{s / (p.height * p.width):.6f}" for s in sums))
                    shapes.append([p.height, p.width, 3])
                    made.append(rgb.tobytes() if tensors else None)
                extra = [pa.array(shapes, pa.list_(pa.int32())), pa.array(made, pa.binary())] if tensors else []
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(payloads, pa.binary()), pa.array(features, pa.string()), *extra], names=[*piece.schema.names, "payload", "feature", *["shape", "tensor"][: len(extra)]])

    return run


def load(media: DataFrame, tensors: bool = True) -> DataFrame:
    """store's rows with the payload read back, the tensor's shape and bytes (row-major; left out on request), and a feature: its shape and channel means."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_load(tensors), "doc_id long, n_bytes long, media binary, payload binary, feature string" + ", shape array<int>, tensor binary" * tensors)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(store(table(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -UNIT, UNIT)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
        "shape", F.octet_length("tensor").cast("long").alias("tensor_bytes"), F.sha2("tensor", 256).alias("tensor_sha256"),
    )


SQL = None
