import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossmill.llm import media, webp
from glossmill.llm.common import as_text

rng = np.random.default_rng(1)


def picture(h, w, kind):
    if kind == "noise":
        return rng.integers(0, 1 << 32, (h, w), dtype=np.uint64).astype(np.uint32)
    if kind == "few":
        return rng.choice(rng.integers(0, 1 << 32, 5, dtype=np.uint64).astype(np.uint32), (h, w))
    if kind == "two":
        return rng.choice(np.array([0xFF000000, 0xFFFFFFFF], np.uint32), (h, w))
    if kind == "flat":
        return np.full((h, w), 0xFF102030, np.uint32)
    y, x = np.mgrid[:h, :w]
    return (0xFF000000 | ((x * 3) & 255) << 16 | ((x + y) & 255) << 8 | ((y * 2) & 255)).astype(np.uint32)


WAYS = [{}, {"cache_bits": 4}, {"subtract": True}, {"cross": (10, -20, 30)}, {"palette": True}, {"palette": True, "predictor": 11}, {"subtract": True, "cross": (1, 2, 3), "predictor": 7, "cache_bits": 10}, *({"predictor": m} for m in range(14))]


@pytest.mark.parametrize("way", WAYS, ids=str)
def test_every_transform_round_trips(way):
    for h, w in ((1, 1), (5, 7), (17, 33)):
        for kind in ("noise", "few", "two", "flat", "slope"):
            a = picture(h, w, kind)
            if not (way.get("palette") and len(np.unique(a)) > 256):
                assert (webp.decode(webp.encode(a, **way)) == a).all()


def test_modes_by_block():
    a = picture(20, 20, "slope")
    assert (webp.decode(webp.encode(a, modes=[k % 14 for k in range(9)])) == a).all()


def test_distances_and_broken_data():
    assert len(set(webp.NEAR)) == 120
    file = webp.encode(picture(9, 9, "noise"))
    with pytest.raises(ValueError):
        webp.decode(b"JUNK" + file[4:])
    with pytest.raises((ValueError, IndexError)):
        webp.decode(webp.wrap(webp.stream(file)[0][:20]))


TEXTS = ["", "a", "x" * 575, "y" * 576, "z" * 577, "é" * 1000, "ÿþ中文🙂" * 99, None, "hello world " * 4000, bytes(range(256)).decode("latin1") * 3]


def padded(text):
    b = (text or "").encode()
    return b + b"\xff" * (576 * max(1, -(-len(b) // 576)) - len(b))


def test_payloads_round_trip_and_both_decoders_agree():
    stored = media.encode_payloads(*as_text(pa.array(TEXTS)))
    for t, f, got in zip(TEXTS, stored, media.decode_payloads(stored), strict=True):
        assert got == padded(t) == media._plain(f)


def test_scripts_repeats_and_few_samples_are_shorter_than_raw():
    r = np.random.default_rng(6)
    draw = lambda a, b, n, gap: "".join(chr(r.integers(a, b)) + (" " if gap and k % gap == 0 else "") for k in range(n))
    texts = [draw(0x430, 0x450, 3000, 6), draw(0x4E00, 0x9000, 3000, 0), draw(0x620, 0x64A, 3000, 5), draw(0xE01, 0xE30, 3000, 0), "a" * 5000, "ab\n" * 2000, "The same sentence again and again. " * 300, draw(32, 127, 3000, 0)]
    stored = media.encode_payloads(*as_text(pa.array(texts)))
    assert media.decode_payloads(stored) == [padded(t) for t in texts]
    assert all(len(f) < 0.95 * len(padded(t)) for t, f in zip(texts, stored, strict=True))
    assert all(len(stored[k]) < 400 for k in (4, 5)) and len(stored[6]) < 1000


def test_documents_stored_in_every_way_are_read_alike():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()[:40]
    ways = [{}, {"cache_bits": 5}, {"predictor": 1}, {"predictor": 11, "cache_bits": 3}, {"subtract": True, "cross": (5, -9, 2)}, {"palette": True, "predictor": 2}]
    for k, t in enumerate(texts):
        p = np.frombuffer(padded(t[:4000]), np.uint8).astype(np.uint32)
        argb = (np.uint32(0xFF000000) | p << np.uint32(8)).reshape(-1, 576)
        assert media.decode_payloads([webp.encode(argb, **ways[k % len(ways)])]) == [padded(t[:4000])]


def test_files_of_another_encoder():
    import base64

    for data in ("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==", "UklGRh4AAABXRUJQVlA4TBEAAAAvAAAAAAfQ//73v/+BiOh/AAA="):
        assert webp.decode(base64.b64decode(data)).shape == (1, 1)


def test_a_payload_of_several_frames(monkeypatch):
    monkeypatch.setattr(media, "FRAME", 576 * 4)
    monkeypatch.setattr(media, "_SLICE", 1000)
    texts = ["".join(rng.choice(list("abcdefghij klmnop"), 20000)), "b"]
    stored = media.encode_payloads(*as_text(pa.array(texts)))
    assert stored[0].count(b"VP8L") == 9 and media.decode_payloads(stored) == [padded(t) for t in texts]


def test_columns(nasty, empty):
    out = media.pixels(media.store(nasty)).select("text", "media", "pixels", F.sha2("pixels", 256).alias("sha"))
    for r in out.collect():
        assert r.pixels == padded(r.text) and r.sha == hashlib.sha256(padded(r.text)).hexdigest()
    assert media.pixels(media.store(empty)).count() == 0
