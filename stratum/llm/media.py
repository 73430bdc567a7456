"""Bytes as PNG images in binary columns, read back with tests, and perceptual hashes.

A payload is stored as the 8-bit grey samples of an image 64 wide. The writer
marks rows that repeat the row above with the Up filter and leaves others
unfiltered, deflates, and cuts the stream into IDAT chunks. The reader tests
the signature, every chunk's CRC-32, the header, zlib's own checksum and the
sizes, and undoes all five filters with numpy.

The hash takes 32 x 32 mean samples, their two-dimensional cosine transform,
and of its 8 x 8 lowest frequencies a bit each: above the median or not.

Null and empty texts give one row of 64 zero bytes. Equal texts give equal
values. A damaged image raises ``DamagedImage``; ``decode_media`` with
``strict=False`` gives nulls instead.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import importable, pieces, string_column, table, tidied

WIDTH = 64
CHUNK = 1 << 16
LEVEL = 6
SIGNATURE = b"\x89PNG\r\n\x1a\n"


class DamagedImage(ValueError):
    """The bytes fail one of the reader's tests."""


def payload_of(text: str) -> tuple[bytes, int]:
    """UTF-8 bytes padded with zeros to a positive multiple of 64, and their number before."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH), len(raw)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def write_png(payload: bytes, width: int = WIDTH) -> bytes:
    """An 8-bit grey image of these samples; their number is a positive multiple of ``width``."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    image = np.zeros((len(rows), width + 1), np.uint8)
    image[:, 1:] = rows
    again = np.flatnonzero((rows[1:] == rows[:-1]).all(1)) + 1
    image[again, 0] = 2
    image[again, 1:] = 0
    data = zlib.compress(image.tobytes(), LEVEL)
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0))]
    parts += [_chunk(b"IDAT", data[at : at + CHUNK]) for at in range(0, len(data), CHUNK)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def read_png(stored: bytes) -> np.ndarray:
    """The samples, height x width, of an 8-bit grey image without interlacing."""
    if stored[:8] != SIGNATURE:
        raise DamagedImage("signature")
    at, header, data, ended = 8, None, [], False
    while at < len(stored) and not ended:
        if at + 12 > len(stored):
            raise DamagedImage("chunk length")
        (size,), kind = struct.unpack_from(">I", stored, at), stored[at + 4 : at + 8]
        body = stored[at + 8 : at + 8 + size]
        if len(body) != size or at + 12 + size > len(stored):
            raise DamagedImage("chunk length")
        if struct.unpack_from(">I", stored, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise DamagedImage(f"checksum of {kind!r}")
        if kind == b"IHDR":
            if size != 13:
                raise DamagedImage("header size")
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            ended = True
        at += 12 + size
    if not ended or header is None or header[2:] != (8, 0, 0, 0, 0):
        raise DamagedImage("header or end")
    width, height = header[:2]
    try:
        raw = zlib.decompress(b"".join(data))
    except zlib.error as e:
        raise DamagedImage("deflate stream") from e
    if len(raw) != height * (width + 1):
        raise DamagedImage("image size")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(height, width + 1))


def unfilter(image: np.ndarray) -> np.ndarray:
    """Samples of rows that begin with their filter type; runs of one type are undone together."""
    kinds, out = image[:, 0], image[:, 1:].copy()
    if not len(out):
        return out
    if kinds.max(initial=0) > 4:
        raise DamagedImage("filter type")
    starts = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]]))
    for first, last in zip(starts, np.append(starts[1:], len(kinds))):
        kind, rows = kinds[first], out[first:last]
        above = out[first - 1] if first else np.zeros_like(out[0])
        if kind == 1:
            np.cumsum(rows, axis=1, dtype=np.uint8, out=rows)
        elif kind == 2:
            rows[0] += above
            np.cumsum(rows, axis=0, dtype=np.uint8, out=rows)
        elif kind > 2:
            for row in rows:
                _running(row, above, kind)
                above = row
    return out


def _running(row: np.ndarray, above: np.ndarray, kind: int) -> None:
    """Average (3) and Paeth (4): each sample needs the one before it."""
    left = corner = 0
    for i, up in enumerate(above.tolist()):
        if kind == 3:
            guess = (left + up) // 2
        else:
            p = left + up - corner
            a, b, c = abs(p - left), abs(p - up), abs(p - corner)
            guess = left if a <= b and a <= c else up if b <= c else corner
        left, corner = (int(row[i]) + guess) & 255, up
        row[i] = left


_k = np.arange(32)
_cosine = np.cos(np.pi * (_k[None, :] + 0.5) * _k[:8, None] / 32)


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits of the image's low frequencies."""
    grid = samples
    for axis in (0, 1):
        size = grid.shape[axis]
        if size < 32:
            grid = np.take(grid, np.arange(32) * size // 32, axis).astype(np.float64)
        else:
            edges = np.arange(33) * size // 32
            grid = np.add.reduceat(grid, edges[:-1], axis, dtype=np.float64)
            grid /= np.expand_dims(np.diff(edges), 1 - axis)
    low = np.rint(_cosine @ grid @ _cosine.T * 1e6)
    return np.packbits(low.ravel() > np.median(low)).tobytes()


def encode_media(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): each whole text as a PNG."""
    importable(docs.sparkSession)

    def encode(batches):
        for batch in pieces(batches):
            for part in pieces([batch], 64):
                made = [payload_of(x) for x in string_column(part, text)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), pa.array([n for _, n in made], pa.int64()), pa.array([write_png(x) for x, _ in made], pa.binary())],
                    [key, "n_bytes", "media"],
                )

    return docs.select(key, text).mapInArrow(tidied(encode), f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, media binary")


MEDIA = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "width int, height int, feature_bits binary"
)


def decode_media(media: DataFrame, *, key: str = "doc_id", strict: bool = True) -> DataFrame:
    """Checked digests and features of (key, n_bytes, media)."""

    def facts(n, stored):
        try:
            if stored is None:
                raise DamagedImage("no bytes")
            samples = read_png(stored)
        except DamagedImage:
            if strict:
                raise
            return (n, *[None] * 8)
        payload = samples.tobytes()
        return (
            n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored),
            hashlib.sha256(stored).hexdigest(), samples.shape[1], samples.shape[0], cosine_hash(samples),
        )

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary()]
    names = [x.split()[0] for x in MEDIA.split(", ")]

    def decode(batches):
        for batch in pieces(batches):
            rows = [facts(n, x) for n, x in zip(batch.column("n_bytes").to_pylist(), batch.column("media").to_pylist())]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns], [key, *names])

    return media.select(key, "n_bytes", "media").mapInArrow(tidied(decode), f"`{key}` {media.schema[key].dataType.simpleString()}, {MEDIA}")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    read = decode_media(encode_media(table(spark, sf_dir, "documents")))
    return read.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.lower(F.hex("feature_bits")).alias("feature")
    )
