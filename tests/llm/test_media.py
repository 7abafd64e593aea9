import hashlib
import struct
import zlib

import numpy as np
import pytest

from corpusloom.llm import media


def paeth_filtered(rows, kinds):
    out = np.zeros_like(rows)
    R = rows.astype(int)
    for y in range(len(rows)):
        for x in range(rows.shape[1]):
            a, b, c = (R[y, x - 1] if x else 0), (R[y - 1, x] if y else 0), (R[y - 1, x - 1] if x and y else 0)
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out[y, x] = (R[y, x] - [0, a, b, (a + b) // 2, near][kinds[y]]) % 256
    return out


@pytest.mark.parametrize("seed", range(5))
def test_all_filters(seed):
    rng = np.random.default_rng(seed)
    rows, kinds = rng.integers(0, 256, (30, 64), dtype=np.uint8), rng.integers(0, 5, 30)
    assert (media.unfilter(kinds, paeth_filtered(rows, kinds)) == rows).all()


@pytest.mark.parametrize("text", ["", "a", "x" * 64, "é" * 100, "The quick brown fox. " * 5000])
def test_round_trip(text):
    payload, n = media.payload_of(text)
    assert n == len(text.encode()) and len(payload) % 64 == 0 and payload and payload.rstrip(b"\0") == text.encode()
    assert media.decode(media.encode(payload)).tobytes() == payload


def test_damage_is_found():
    data = bytearray(media.encode(media.payload_of("some text " * 50)[0]))
    for at in range(0, len(data), 7):
        bad = bytes(data[:at]) + bytes([data[at] ^ 1]) + bytes(data[at + 1 :])
        with pytest.raises(media.MediaError):
            media.decode(bad)
    with pytest.raises(media.MediaError):
        media.decode(bytes(data[:-5]))
    colour = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 2, 0, 0, 0)) + media._chunk(b"IDAT", zlib.compress(b"\0abc")) + media._chunk(b"IEND", b"")
    with pytest.raises(media.MediaError):
        media.decode(colour)


def test_hash_by_plain_transform():
    x = np.random.default_rng(2).integers(0, 256, (37, 64), dtype=np.uint8)
    small = np.repeat(np.repeat(x.astype(float), 32, 0).reshape(32, 37, 64).mean(1), 32, 1).reshape(32, 32, 64).mean(2)
    low = np.array([[sum(small[i, j] * np.cos(np.pi * (2 * i + 1) * u / 64) * np.cos(np.pi * (2 * j + 1) * v / 64) for i in range(32) for j in range(32)) for v in range(8)] for u in range(8)]).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    assert media.cosine_hash(x) == np.packbits(bits).tobytes().hex()
    tall = np.repeat(x, 100, axis=0)
    assert media.cosine_hash(tall) == media.cosine_hash(x)


def test_operator(spark, odd, none_at_all):
    rows = {(r.doc_id, r.payload_sha256): r for r in media.media_digests(odd).collect()}
    for r in odd.collect():
        payload, n = media.payload_of(r.text)
        got = rows[r.doc_id, hashlib.sha256(payload).hexdigest()]
        assert (got.n_bytes, got.payload_bytes, got.tail_crc32) == (n, len(payload), zlib.crc32(payload[-64:]))
    assert media.media_digests(odd).count() == odd.count()
    assert media.media_digests(none_at_all).count() == 0
