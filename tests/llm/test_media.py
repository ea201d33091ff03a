import hashlib
import zlib

import numpy as np
import pytest

from tests.llm.data import corpus, frame
from tessera.llm import media


@pytest.mark.parametrize("units", [1, 2, 5, 6, 7, 13, 60])
def test_both_readers(units):
    """The reader of bit planes and the bit-by-bit reader of the standard agree, and give the payload back."""
    for payload in (np.random.default_rng(units).integers(0, 256, 64 * units, np.uint8).tobytes(), bytes(64 * units), b"\xff" * 64 * units):
        stream = media.encode(payload)
        fast, slow = media.Picture(stream), media.Picture(stream, slowly=True)
        assert fast.payload() == slow.payload() == payload
        assert all((a == b).all() for a, b in zip(fast.coef, slow.coef))


def test_long_payload(monkeypatch):
    payload = np.random.default_rng(0).integers(0, 256, 64 * 70_000, np.uint8).tobytes()
    picture = media.Picture(media.encode(payload))
    assert picture.payload() == payload and picture.cols > 1
    whole = picture.rgb()
    monkeypatch.setattr(media, "_STRIP", 7)
    assert (picture.rgb() == whole).all()


def test_pixels():
    """The integer transform is that of the definition, to one step."""
    picture = media.Picture(media.encode(np.random.default_rng(1).integers(0, 256, 64 * 6, np.uint8).tobytes()))
    u = np.arange(8)
    c = np.where(u == 0, np.sqrt(0.125), 0.5)
    basis = c[:, None] * np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16)
    planes = []
    for coef, shape in zip(picture.coef, ((2, 2), (1, 1), (1, 1))):
        blocks = np.zeros((len(coef), 8, 8))
        for k, (r, col) in enumerate(media._DIAG):
            blocks[:, r, col] = coef[:, k]
        pixels = np.einsum("bij,ix,jy->bxy", blocks, basis, basis) + 128
        planes.append(np.clip(np.rint(pixels), 0, 255).reshape(*shape, 8, 8).swapaxes(1, 2).reshape(8 * shape[0], 8 * shape[1]))
    y, cb, cr = planes[0], planes[1].repeat(2, 0).repeat(2, 1) - 128, planes[2].repeat(2, 0).repeat(2, 1) - 128
    rgb = np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1), 0, 255)
    assert np.abs(picture.rgb().astype(int) - rgb).max() <= 3


def test_zigzag():
    assert media._DIAG[:6] == [(0, 0), (0, 1), (1, 0), (2, 0), (1, 1), (0, 2)] and media._DIAG[-1] == (7, 7) and len(set(media._DIAG)) == 64


def test_query_rows(spark, tmp_path):
    rows = corpus()
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    texts = dict(rows) | {None: rows[5][1]}
    found = media.query(spark, str(tmp_path)).collect()
    assert len(found) == len(rows) + 3
    for r in found:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        stream = media.encode(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stream), hashlib.sha256(stream).hexdigest())
        picture = media.Picture(stream)
        assert r.feature.startswith(f"{picture.height}x16x3 ") and r.shape == [picture.height, 16, 3]
        assert (r.tensor_bytes, r.tensor_sha256) == (48 * picture.height, hashlib.sha256(picture.rgb().tobytes()).hexdigest())
    assert media.load(media.store(frame(spark, rows).limit(0))).collect() == []


def test_tensors(spark):
    r = media.load(media.store(frame(spark, [(1, "abc")], False))).first()
    assert r.shape == [16, 16, 3] and len(r.tensor) == 768 and bytes(r.payload).rstrip(b"\0") == b"abc"


def _java(spark):
    """The JVM's own JPEG writer and reader."""
    jvm = spark._jvm
    return jvm, jvm.javax.imageio.ImageIO


def _theirs(spark, stream):
    """Height, width and RGB pixels as the JVM's reader decodes them."""
    jvm, io = _java(spark)
    image = io.read(jvm.java.io.ByteArrayInputStream(bytearray(stream)))
    h, w = image.getHeight(), image.getWidth()
    packed = np.array(list(image.getRGB(0, 0, w, h, None, 0, w)), np.int64) & 0xFFFFFF
    return np.stack([packed >> 16, packed >> 8 & 255, packed & 255], -1).reshape(h, w, 3)


@pytest.mark.parametrize("h, w", [(16, 16), (40, 56), (37, 51)])
def test_pictures_of_another_writer(spark, h, w):
    """A progressive picture by another program, with its own scans and tables, has the pixels its own reader gives."""
    jvm, io = _java(spark)
    y, x = np.mgrid[0:h, 0:w]
    rgb = np.stack([127 + 90 * np.sin(x / 9), 127 + 90 * np.cos(y / 7), 120 + 60 * np.sin((x + y) / 11)], -1).astype(np.int64)
    image = jvm.java.awt.image.BufferedImage(w, h, 1)
    for r in range(h):
        for c in range(w):
            image.setRGB(c, r, int(rgb[r, c, 0] << 16 | rgb[r, c, 1] << 8 | rgb[r, c, 2]))
    writer = io.getImageWritersByFormatName("jpeg").next()
    how = writer.getDefaultWriteParam()
    how.setProgressiveMode(1)
    how.setCompressionMode(2)
    how.setCompressionQuality(0.95)
    out = jvm.java.io.ByteArrayOutputStream()
    writer.setOutput(io.createImageOutputStream(out))
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), how)
    writer.getOutput().flush()
    stream = bytes(out.toByteArray())
    assert b"\xff\xc2" in stream
    picture = media.Picture(stream)
    theirs = _theirs(spark, stream)
    assert (picture.height, picture.width) == (h, w)
    apart = np.abs(picture.rgb().astype(int) - theirs)
    # Chroma is smoothed by their reader, repeated by ours.
    assert apart.mean() < 3 and np.abs(picture.rgb().mean(axis=(0, 1)) - theirs.mean(axis=(0, 1))).max() < 1.5


def test_another_reader_reads_our_streams(spark):
    """The JVM's reader takes our streams and gives pictures of their size."""
    payload = np.random.default_rng(3).integers(0, 256, 64 * 13, np.uint8).tobytes()
    stream = media.encode(payload)
    theirs, ours = _theirs(spark, stream), media.Picture(stream).rgb()
    assert theirs.shape == ours.shape


def test_other_kinds_are_refused():
    with pytest.raises(ValueError):
        media.Picture(b"\xff\xd8\xff\xc0\x00\x0b\x08\x00\x10\x00\x10\x01\x01\x11\x00\xff\xd9")
