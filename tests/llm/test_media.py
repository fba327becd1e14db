import hashlib
import random
import zlib

import numpy as np
import pytest

from terrastack.llm import media


@pytest.mark.parametrize("shape", [(1, 64), (9, 64), (33, 7), (200, 64)])
@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4, "mixed", "chosen"])
def test_every_filter_round_trips(shape, kind):
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, shape).astype(np.uint8)
    filters = None if kind == "chosen" else rng.integers(0, 5, shape[0]).astype(np.uint8) if kind == "mixed" else np.full(shape[0], kind, np.uint8)
    assert (media.decode_png(media.encode_png(image, filters=filters)) == image).all()


def test_damage_is_found():
    blob = media.encode_png(np.arange(640, dtype=np.uint8).reshape(10, 64))
    for i in range(0, len(blob), 3):
        bad = bytearray(blob)
        bad[i] ^= 1
        with pytest.raises((ValueError, zlib.error)):
            media.decode_png(bytes(bad))
    for cut in (3, 20, len(blob) - 1):
        with pytest.raises(ValueError):
            media.decode_png(blob[:cut])


def test_chunks_are_split():
    noise = np.random.default_rng(1).integers(0, 256, (2000, 64)).astype(np.uint8)
    blob = media.encode_png(noise)
    assert blob.count(b"IDAT") >= 4
    assert (media.decode_png(blob) == noise).all()


def test_rows_equal_the_contract(spark):
    rng = random.Random(1)
    texts = [None, "", "a", "é☃𝒳", "x" * 64, "y" * 65, "z" * 300_000, "same", "same"] + ["".join(rng.choices("abc \n", k=rng.randrange(3000))) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in media.media_features(media.store_media(docs)).collect()}
    stored = {r.doc_id: bytes(r.media) for r in media.store_media(docs).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        padded = raw + bytes(max(1, -(-len(raw) // 64)) * 64 - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert r.tail_crc32 == zlib.crc32(padded[-64:])
        assert (r.media_bytes, r.media_sha256) == (len(stored[i]), hashlib.sha256(stored[i]).hexdigest())
        assert r.feature == bytes(r.hash).hex() and len(r.feature) == 16
    assert got[7].feature == got[8].feature and got[7].media_sha256 == got[8].media_sha256
    assert media.media_features(media.store_media(docs.where("false"))).collect() == []


def test_null_ids_and_a_very_long_text(spark):
    long = "long words of a text " * 250_000
    rows = [(None, "same", "x"), (None, "same", "x"), (None, None, None), (1, long, "x")]
    found = media.media_features(media.store_media(spark.createDataFrame(rows, "doc_id long, text string, media string"))).collect()
    assert sorted((r.doc_id or 0, r.n_bytes) for r in found) == [(0, 0), (0, 4), (0, 4), (1, len(long))]
    padded = long.encode() + bytes(-len(long) % 64)
    assert next(r.payload_sha256 for r in found if r.doc_id == 1) == hashlib.sha256(padded).hexdigest()


def brute_hash(image):
    """Area means and cosine sums written out."""
    rows, width = image.shape

    def cells(n):
        edges = [n * i / 32 for i in range(33)]
        return [[max(0.0, min(b, c + 1) - max(a, c)) / (b - a) for c in range(n)] for a, b in zip(edges, edges[1:], strict=False)]

    down, across = cells(rows), cells(width)
    small = [[sum(down[i][r] * across[j][c] * image[r, c] for r in range(rows) if down[i][r] for c in range(width) if across[j][c]) for j in range(32)] for i in range(32)]
    low = [sum(small[i][j] * np.cos(np.pi * u * (2 * i + 1) / 64) * np.cos(np.pi * v * (2 * j + 1) / 64) for i in range(32) for j in range(32)) for u in range(1, 9) for v in range(1, 9)]
    return np.packbits(np.array(low) > np.median(low)).tobytes()


def test_cosine_hash_equals_brute_force_and_resists_small_changes():
    image = np.random.default_rng(5).integers(0, 256, (12, 64)).astype(np.uint8)
    assert media.cosine_hash(image) == brute_hash(image)
    near = image.copy()
    near[3, 10] ^= 4
    apart = np.unpackbits(np.frombuffer(media.cosine_hash(image), np.uint8) ^ np.frombuffer(media.cosine_hash(near), np.uint8)).sum()
    assert apart <= 4
