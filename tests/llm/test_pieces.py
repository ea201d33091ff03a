import hashlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from tests.conftest import DATA
from tests.llm.data import corpus, frame
from tessera.llm import pieces
from tessera.llm.common import utf8

ODD = ["", "  a  b\n\n c\t", "hello   world  ", "日本語 テキスト\x00 <s> </s> <unk>", "▁▁x ▁y", "\n", "a\r\nb", " ", "🙂🙂 é́", "​x y", "a" * 3000, "ß" * 50 + " " * 40 + "x"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_parity(library):
    """Whole texts of the table give the library's ids."""
    import duckdb

    texts = [r[0] for r in duckdb.execute(f"SELECT text FROM read_parquet('{DATA}/sf0.01/documents.parquet')").fetchall()] + ODD
    codec = pieces.codec(open(pieces.MODEL, "rb").read())
    ids, counts, same, agreed = codec.encode(*utf8(pa.array(texts)))
    ends = np.cumsum(counts)
    expected = library.encode(texts)
    assert all(list(ids[e - n : e]) == x for e, n, x in zip(ends, counts, expected)) and agreed.all()
    assert [t for t, s in zip(texts, same) if not s] == ["▁▁x ▁y"]
    assert all(codec.decode(ids[e - n : e]) == t for t, e, n in zip(texts, ends, counts) if "▁" not in t)


def test_rows(spark, library):
    rows = corpus() + [(1000 + i, t) for i, t in enumerate(ODD)]
    df = frame(spark, rows)
    encoded = pieces.encode_documents(df)
    found = encoded.collect()
    assert len(found) == df.count()
    texts = dict(rows) | {None: rows[5][1]}
    for r in found:
        ids = library.encode(texts[r.doc_id] or "")
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest() and r.parity
    for r in pieces.decode_documents(encoded).collect():
        if "▁" not in (texts[r.doc_id] or ""):
            assert r.text == (texts[r.doc_id] or "")
    assert pieces.encode_documents(df.limit(0)).collect() == []


def test_forgetting(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    monkeypatch.setattr(pieces, "SLICE", 7)
    data = open(pieces.MODEL, "rb").read()
    small, large = pieces.Codec(pieces.Model(data), data), pieces.codec(data)
    for lo in range(0, 40, 8):
        part = utf8(pa.array([t for _, t in corpus()][lo : lo + 8]))
        assert all((a == b).all() for a, b in zip(small.encode(*part), large.encode(*part)))


def test_unigram(tmp_path):
    """A unigram model with byte fallback, written by hand as a protobuf, is encoded as the library does."""

    def field(n, kind, body):
        return bytes([n << 3 | kind]) + body

    def message(n, body):
        size, out = len(body), b""
        while True:
            out += bytes([size & 127 | (128 if size > 127 else 0)])
            size >>= 7
            if not size:
                return field(n, 2, out + body)

    def piece(text, score, kind):
        return message(1, message(1, text.encode()) + field(2, 5, np.array([score], "<f4").tobytes()) + field(3, 0, bytes([kind])))

    words = [("▁", -2.0), ("▁a", -1.0), ("b", -1.5), ("▁ab", -2.2), ("a", -3.0), ("c", -2.5), ("bc", -2.6), ("cc", -4.0)]
    trainer = message(2, field(3, 0, b"\x01") + bytes([0x98, 0x02, 0x01]))  # model_type 1, byte_fallback (field 35)
    normal = message(3, message(1, b"identity") + bytes([0x18, 0x01, 0x20, 0x00, 0x28, 0x01]))
    data = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + piece("</s>", 0, 3) + b"".join(piece(f"<0x{i:02X}>", 0, 6) for i in range(256)) + b"".join(piece(w, s, 1) for w, s in words) + trainer + normal
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    codec = pieces.Codec(pieces.Model(data), data)
    assert codec.model.kind == pieces.UNIGRAM and not codec.cuts
    texts = ["abc", "a b c", "abcc bcb", "", "c a  b", "abé c"]
    ids, counts, _, agreed = codec.encode(*utf8(pa.array(texts)))
    assert [list(x) for x in np.split(ids, np.cumsum(counts)[:-1])] == library.encode(texts) and agreed.all()
