"""Media columns: texts stored as PNG images in a binary column, read back with checksum tests, and hashed by cosine transform.

A payload is laid out as 8-bit grey samples, `width` to a row. The encoder filters rows by least sum of absolute differences
(None, Sub or Up), deflates that and the unfiltered rows, and keeps the shorter stream, cut into IDAT chunks; the decoder tests the signature,
every chunk's CRC and order, inflates, and undoes all five PNG filters with numpy.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = 0, 1, 2, 3, 4

UNIT = 64
IDAT_BYTES = 1 << 15
#: Rows whose Average or Paeth filter is undone together, and lengths up to which transforms are kept.
DIAGONAL_ROWS, SHORT = 4096, 512


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(image: np.ndarray, level: int = 4, filters: np.ndarray | None = None) -> bytes:
    """PNG bytes of a (rows, width) uint8 array. `filters` fixes each row's filter (0 to 4) instead of choosing it."""
    rows, width = image.shape
    above = np.zeros_like(image)
    above[1:] = image[:-1]
    left = np.zeros_like(image)
    left[:, 1:] = image[:, :-1]
    deflate = lambda kinds, body: zlib.compress(np.concatenate([kinds[:, None], body], axis=1).tobytes(), level)
    if filters is None:
        choices = np.stack([image, image - left, image - above])
        cost = np.abs(choices.view(np.int8).astype(np.int16)).sum(2)
        filters = cost.argmin(0).astype(np.uint8)
        plain = deflate(np.zeros(rows, np.uint8), image)
        stream = min(plain, deflate(filters, choices[filters, np.arange(rows)]), key=len)
    else:
        corner = np.zeros_like(image)
        corner[1:, 1:] = image[:-1, :-1]
        mean = ((left.astype(np.uint16) + above) >> 1).astype(np.uint8)
        choices = np.stack([image, image - left, image - above, image - mean, image - _paeth(left, above, corner)])
        stream = deflate(filters, choices[filters, np.arange(rows)])
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, rows, 8, 0, 0, 0, 0))]
    parts += [_chunk(b"IDAT", stream[i : i + IDAT_BYTES]) for i in range(0, len(stream), IDAT_BYTES)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def _paeth(left: np.ndarray, above: np.ndarray, corner: np.ndarray) -> np.ndarray:
    a, b, c = (x.astype(np.int16) for x in (left, above, corner))
    guess = a + b - c
    da, db, dc = abs(guess - a), abs(guess - b), abs(guess - c)
    return np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c)).astype(np.uint8)


def decode_png(blob: bytes) -> np.ndarray:
    """The (rows, width) samples of an 8-bit grey PNG. Raises ValueError on a bad signature, checksum, order or length."""
    if blob[:8] != SIGNATURE:
        raise ValueError("not a PNG: bad signature")
    at, header, stream, ended = 8, None, [], False
    while at < len(blob) and not ended:
        if at + 12 > len(blob):
            raise ValueError("truncated chunk")
        size, kind = struct.unpack_from(">I4s", blob, at)
        data = blob[at + 8 : at + 8 + size]
        if len(data) != size or at + 12 + size > len(blob):
            raise ValueError("truncated chunk")
        if struct.unpack_from(">I", blob, at + 8 + size)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise ValueError(f"checksum of chunk {kind!r} does not match")
        if header is None and kind != b"IHDR":
            raise ValueError("IHDR is not the first chunk")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            stream.append(data)
        ended = kind == b"IEND"
        at += 12 + size
    if header is None or not ended:
        raise ValueError("chunks are missing")
    width, rows, depth, colour, packing, filtering, interlace = header
    if (depth, colour, packing, filtering, interlace) != (8, 0, 0, 0, 0):
        raise ValueError("only 8-bit grey images without interlace are read")
    raw = np.frombuffer(zlib.decompress(b"".join(stream)), np.uint8)
    if raw.size != rows * (width + 1):
        raise ValueError("image data has the wrong length")
    lines = raw.reshape(rows, width + 1)
    return unfilter(lines[:, 0], lines[:, 1:])


def unfilter(filters: np.ndarray, body: np.ndarray) -> np.ndarray:
    """Undoes the row filters, run by run of equal ones: Sub along rows, Up down columns, Average and Paeth along diagonals."""
    if filters.size and filters.max() > PAETH:
        raise ValueError("unknown row filter")
    out = np.empty_like(body)
    previous = np.zeros(body.shape[1], np.uint8)
    cuts = np.flatnonzero(np.diff(filters)) + 1
    for start, end in zip([0, *cuts], [*cuts, len(filters)], strict=True):
        if start == end:
            continue
        kind = filters[start]
        if kind == NONE:
            out[start:end] = body[start:end]
        elif kind == SUB:
            np.cumsum(body[start:end], axis=1, dtype=np.uint8, out=out[start:end])
        elif kind == UP:
            np.cumsum(body[start:end], axis=0, dtype=np.uint8, out=out[start:end])
            out[start:end] += previous
        else:
            for first in range(start, end, DIAGONAL_ROWS):
                last = min(first + DIAGONAL_ROWS, end)
                _undo_diagonals(kind, body[first:last], out[first - 1] if first else previous, out[first:last])
        previous = out[end - 1]
    return out


def _undo_diagonals(kind: int, body: np.ndarray, above: np.ndarray, out: np.ndarray) -> None:
    """Average and Paeth need the samples to the left, above and between: all samples of one diagonal are undone together."""
    rows, width = body.shape
    done = np.zeros((rows + 1, width + 1), np.uint8)  # a row above and a column of zeros to the left
    done[0, 1:] = above
    for diagonal in range(rows + width - 1):
        r = np.arange(max(0, diagonal - width + 1), min(rows, diagonal + 1))
        c = diagonal - r
        left, up = done[r + 1, c], done[r, c + 1]
        guess = ((left.astype(np.uint16) + up) >> 1).astype(np.uint8) if kind == AVERAGE else _paeth(left, up, done[r, c])
        done[r + 1, c + 1] = body[r, c] + guess
    out[:] = done[1:, 1:]


def area_means(image: np.ndarray, cells: int = 32) -> np.ndarray:
    """(cells, width): means over equal parts of the rows, which may end inside a row. Needs little more memory than its result."""
    rows = len(image)
    edges = np.linspace(0, rows, cells + 1)
    whole = np.minimum(edges.astype(np.int64), rows - 1)
    before = np.cumsum([image[a:b].sum(0, dtype=np.float64) for a, b in zip([0, *whole[:-1]], whole, strict=True)], axis=0)
    total = before + (edges - whole)[:, None] * image[whole]
    return np.diff(total, axis=0) * (cells / rows)


def _cosines(grid: int = 32, low: int = 8) -> np.ndarray:
    """(low, grid): the first `low` cosine-transform rows after the constant one."""
    k, x = np.arange(1, low + 1)[:, None], np.arange(grid)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * grid))


@lru_cache(maxsize=None)
def _short_transform(length: int) -> np.ndarray:
    """(8, length): area means and cosine rows in one matrix, for lengths up to SHORT alone: all of them together take 8 MB."""
    return _cosines() @ area_means(np.eye(length))


def low_frequencies(samples: np.ndarray) -> np.ndarray:
    """(8, width): the lowest non-constant cosine coefficients of 32 area means over the rows."""
    return _short_transform(len(samples)) @ samples if len(samples) <= SHORT else _cosines() @ area_means(samples)


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest non-constant cosine coefficients of the 32 x 32 thumbnail exceed their median."""
    flat = np.round(low_frequencies(low_frequencies(image).T).T.ravel(), 6)
    return np.packbits(flat > np.median(flat)).tobytes()


def to_image(text: str, width: int = UNIT) -> tuple[np.ndarray, int]:
    """The UTF-8 bytes padded with zeros to a positive multiple of 64, as rows of `width`; and the unpadded length."""
    payload = text.encode("utf-8", "surrogatepass")
    padded = payload + bytes(-len(payload) % UNIT or (0 if payload else UNIT))
    return np.frombuffer(padded, np.uint8).reshape(-1, width), len(payload)


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text of `docs` (doc_id, text) as a PNG in a binary column.

    Null and empty texts become one row of 64 zero samples; texts of any length are stored whole; equal texts give equal images (there are no ties to
    break); repeated rows, and rows with a null doc_id, stay rows of their own; empty tables give no rows. Other columns, whatever their
    names, are left out.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                images = [to_image(t or "") for t in part.column(1).to_pylist()]
                blobs = pa.array([encode_png(image) for image, _ in images], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for _, n in images], pa.int64()), blobs], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Reads the stored images back (checksum tests included) and describes them: lengths, digests, cosine hash.

    `hash` is binary (8 bytes) and `feature` its hexadecimal form. A damaged (or null) image raises an error: nothing is skipped silently. Rows go
    through one by one, so what store_media says of nulls, lengths, repeated rows, empty tables and other columns holds here.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "hash"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n_bytes, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                image = decode_png(blob)
                payload, digest = image.tobytes(), cosine_hash(image)
                rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(blob), hashlib.sha256(blob).hexdigest(), digest.hex(), digest))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, hash binary"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(describe, schema)
