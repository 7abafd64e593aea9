"""Media columns: payload bytes kept as 8-bit grey PNG in a binary column, with checksum tests and cosine-transform hashes.

A payload of a positive multiple of 64 bytes is an image 64 samples wide. The writer gives an image the row filter
(none, sub or up) with the least sum of absolute residues and compresses with zlib; the reader tests signature, chunk lengths,
CRC-32s and the Adler sum and undoes all five filters of the format in numpy. The feature is the sign pattern of the
8 x 8 lowest cosine-transform terms of the image scaled to 32 x 32.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches

SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed value of the format
WIDTH = 64
LEVEL = 3


class MediaError(ValueError):
    """Stored bytes that break the format or fail a checksum."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode(payload: bytes, width: int = WIDTH, level: int = LEVEL) -> bytes:
    """A lossless grey PNG of the payload, whose length is a positive multiple of ``width``."""
    if not payload or len(payload) % width:
        raise MediaError(f"a payload must fill one or more rows of {width} samples")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    sub = rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up = rows.copy()
    up[1:] -= rows[:-1]
    best = int(np.argmin([np.abs(f.view(np.int8), dtype=np.int16).sum() for f in (rows, sub, up)]))
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = (rows, sub, up)[best]
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _chunks(data: bytes):
    if data[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise MediaError("a chunk is cut short")
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) != size or at + 12 + size > len(data):
            raise MediaError("a chunk is cut short")
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise MediaError(f"wrong checksum of {kind!r}")
        yield kind, body
        at += 12 + size
        if kind == b"IEND":
            return
    raise MediaError("no end chunk")


def _wavefront(lines: np.ndarray, first: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Undoes average and Paeth filters (and the others among them) along anti-diagonals, where samples are independent."""
    height, width = lines.shape
    out = np.zeros((height + 1, width + 1), np.int32)
    out[0, 1:] = first
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        left, above, corner, kind = out[y + 1, x], out[y, x + 1], out[y, x], kinds[y]
        guess = left + above - corner
        a, b, c = abs(guess - left), abs(guess - above), abs(guess - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
        add = np.select([kind == 0, kind == 1, kind == 2, kind == 3], [np.zeros_like(left), left, above, (left + above) // 2], paeth)
        out[y + 1, x + 1] = (lines[y, x] + add) & 255
    return out[1:, 1:].astype(np.uint8)


def unfilter(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Samples from filtered rows of one byte a sample. Runs of equal filters are undone by whole-array sums."""
    if kinds.size and kinds.max() > 4:
        raise MediaError("unknown filter")
    out = lines.copy()
    side = kinds == 1
    out[side] = np.cumsum(lines[side], axis=1, dtype=np.uint8)
    group = np.where(kinds >= 3, 3, np.where(kinds == 2, 2, 0))
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(kinds)]):
        if a == b or group[a] == 0:
            continue
        above = out[a - 1] if a else np.zeros(lines.shape[1], np.uint8)
        if group[a] == 2:
            np.cumsum(lines[a:b], axis=0, dtype=np.uint8, out=out[a:b])
            out[a:b] += above
        else:
            out[a:b] = _wavefront(lines[a:b], above, kinds[a:b])
    return out


def decode(data: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG, height x width. Raises MediaError for anything damaged or of another kind."""
    head, packed = None, []
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            if len(body) != 13:
                raise MediaError("wrong header length")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise MediaError("only 8-bit grey images without interlacing are read")
    width, height = head[:2]
    unpack = zlib.decompressobj()
    try:
        raw = unpack.decompress(b"".join(packed)) + unpack.flush()
    except zlib.error as e:
        raise MediaError(str(e)) from e
    if not unpack.eof or len(raw) != height * (width + 1):
        raise MediaError("wrong amount of image data")
    lines = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    return unfilter(lines[:, 0], lines[:, 1:])


_BINS = 32
_COSINES = np.cos(np.pi * (2 * np.arange(_BINS) + 1)[None, :] * np.arange(8)[:, None] / (2 * _BINS))


def _scaled(samples: np.ndarray, bins: int) -> np.ndarray:
    """Means over ``bins`` equal stretches of the first axis; stretches may begin within a sample."""
    n = len(samples)
    edges = np.arange(bins + 1) * (n / bins)
    whole = np.minimum(edges.astype(np.int64), n - 1)
    parts = np.add.reduceat(samples, np.unique(whole), axis=0, dtype=np.float64) if n > 1 else samples.astype(np.float64)
    total = np.zeros((len(parts) + 1, *samples.shape[1:]))
    np.cumsum(parts, axis=0, out=total[1:])
    at = total[np.searchsorted(np.unique(whole), whole)] + (edges - whole)[:, None] * samples[whole]
    return np.diff(at, axis=0) / (n / bins)


@lru_cache(maxsize=4096)
def _terms(n: int) -> np.ndarray:
    """8 x n: the cosine terms of ``n`` samples scaled to ``_BINS`` means."""
    at, edge = np.arange(n)[None, :], np.arange(_BINS)[:, None] * (n / _BINS)
    share = np.clip(np.minimum(edge + n / _BINS, at + 1) - np.maximum(edge, at), 0, None)
    return _COSINES @ share / (n / _BINS)


def cosine_hash(samples: np.ndarray) -> str:
    """16 hex digits: which of the 8 x 8 lowest cosine terms lie above their median; the mean term is left out of it."""
    height, width = samples.shape
    down = _terms(height) @ samples.astype(np.float64) if height <= 2048 else _COSINES @ _scaled(samples, _BINS)
    low = down @ _terms(width).T if width <= 2048 else (_COSINES @ _scaled(down.T, _BINS)).T
    low = low.round(6).ravel()
    bits = low > np.partition(low[1:], 31)[31]
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def payload_of(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode()
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH)), len(data)


def store(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """``df`` with ``n_bytes`` and the binary column ``out`` in place of ``text``. A null text is stored as an empty one."""
    names = [c for c in df.columns if c not in (text, out, "n_bytes")]

    def run(source):
        for batch in batches(source, 1 << 22):
            made = [payload_of(t) for t in batch.column(text).to_pylist()]
            columns = [*(batch.column(n) for n in names), pa.array([n for _, n in made], pa.int64()), pa.array([encode(p) for p, _ in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_bytes", out])

    kept = df.select(*names, text)
    fields = [f for f in kept.schema.fields if f.name != text]
    return kept.mapInArrow(run, T.StructType([*fields, T.StructField("n_bytes", T.LongType()), T.StructField(out, T.BinaryType())]))


_FEATURES = ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("width", T.IntegerType()), ("height", T.IntegerType())


def describe(df: DataFrame, media: str = "media") -> DataFrame:
    """Reads the binary column back and replaces it by digests and the perceptual feature; a null gives nulls."""
    added = [k for k, _ in _FEATURES]
    names = [c for c in df.columns if c not in (media, *added)]

    def row(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * len(added)
        samples = decode(data)
        payload = samples.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(samples), samples.shape[1], samples.shape[0]

    def run(source):
        for batch in batches(source, 1 << 22):
            rows = list(zip(*(row(d) for d in batch.column(media).to_pylist())))
            made = [pa.array(v, t) for v, t in zip(rows, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *made], names=[*names, *added])

    kept = df.select(*names, media)
    fields = [f for f in kept.schema.fields if f.name != media]
    return kept.mapInArrow(run, T.StructType([*fields, *(T.StructField(k, t) for k, t in _FEATURES)]))


def media_digests(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents``; equal texts have equal values, empty and null texts those of 64 zero bytes."""
    return describe(store(documents.select("doc_id", F.col("text")))).select("doc_id", "n_bytes", *(k for k, _ in _FEATURES))
