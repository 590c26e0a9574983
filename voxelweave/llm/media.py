"""PNG images in binary columns: a checksummed codec and low-frequency cosine hashes.

The codec writes and reads 8-bit PNG files (greyscale, grey+alpha, RGB, RGBA; not
interlaced). Every chunk's CRC-32 is tested on reading, and zlib tests the Adler-32
of the samples. Filters are undone with numpy: runs of rows of one kind together,
Average and Paeth along anti-diagonals.

Defined cases: a null image gives null features; a damaged, empty or too large image raises ValueError in
`decode` and gives null features in `hash_images`; null text is the empty text, which
is one row of 64 zero samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
COLOUR = {1: 0, 3: 2, 2: 4, 4: 6}
IDAT_BYTES = 1 << 16
#: Images of more bytes of samples aren't decoded; nothing is inflated beyond what the header promises.
MOST_BYTES = 1 << 30


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Predictor of int16 neighbours: left, above, above left."""
    p = a + b - c
    da, db, dc = np.abs(p - a), np.abs(p - b), np.abs(p - c)
    return np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))


def _filtered(rows: np.ndarray, bpp: int, kind: int) -> np.ndarray:
    """Rows (height, bytes) after the forward filter; arithmetic is modulo 256."""
    left = np.zeros_like(rows)
    left[:, bpp:] = rows[:, :-bpp]
    if kind == 0:
        return rows
    if kind == 1:
        return rows - left
    above = np.zeros_like(rows)
    above[1:] = rows[:-1]
    if kind == 2:
        return rows - above
    if kind == 3:
        return rows - ((left.astype(np.uint16) + above) >> 1).astype(np.uint8)
    corner = np.zeros_like(rows)
    corner[1:, bpp:] = rows[:-1, :-bpp]
    return rows - _paeth(*(x.astype(np.int16) for x in (left, above, corner))).astype(np.uint8)


def encode(samples: np.ndarray, filters: tuple[int, ...] = (0, 1, 2), level: int = 6) -> bytes:
    """PNG of uint8 samples (height, width) or (height, width, channels); each row takes the filter of least absolute sum."""
    samples = samples[..., None] if samples.ndim == 2 else samples
    height, width, channels = samples.shape
    rows = np.ascontiguousarray(samples).reshape(height, width * channels)
    options = [_filtered(rows, channels, k) for k in filters]
    if len(options) == 1:
        kinds, best = np.full(height, filters[0], np.uint8), options[0]
    else:
        cost = np.stack([np.minimum(x, 0 - x).sum(1, dtype=np.int64) for x in options])
        pick = cost.argmin(0)
        kinds = np.asarray(filters, np.uint8)[pick]
        best = np.stack(options)[pick, np.arange(height)]
    body = zlib.compress(np.concatenate((kinds[:, None], best), 1).tobytes(), level)
    header = struct.pack(">IIBBBBB", width, height, 8, COLOUR[channels], 0, 0, 0)
    parts = [SIGNATURE, _chunk(b"IHDR", header)]
    parts += [_chunk(b"IDAT", body[i : i + IDAT_BYTES]) for i in range(0, len(body), IDAT_BYTES)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def _diagonals(out: np.ndarray, first: int, last: int, bpp: int, kind: int) -> None:
    """Undo Average or Paeth for rows first..last of out (with a border row and pixel), one anti-diagonal at a time."""
    height, width = last - first, out.shape[1] // bpp - 1
    flat = out.reshape(out.shape[0], width + 1, bpp)
    for d in range(height + width - 1):
        i = np.arange(max(0, d - width + 1), min(height, d + 1))
        r, c = first + i + 1, d - i + 1
        a, b = flat[r, c - 1].astype(np.int16), flat[r - 1, c].astype(np.int16)
        guess = (a + b) >> 1 if kind == 3 else _paeth(a, b, flat[r - 1, c - 1].astype(np.int16))
        flat[r, c] = flat[r, c] + guess.astype(np.uint8)


def unfilter(kinds: np.ndarray, rows: np.ndarray, bpp: int) -> np.ndarray:
    height, size = rows.shape
    out = np.zeros((height + 1, size + bpp), np.uint8)
    out[1:, bpp:] = rows
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for first, last in zip([0, *edges.tolist()], [*edges.tolist(), height]):
        kind = int(kinds[first])
        block = out[first + 1 : last + 1, bpp:]
        if kind == 1:
            block[:] = np.cumsum(block.reshape(last - first, -1, bpp), 1, dtype=np.uint8).reshape(block.shape)
        elif kind == 2:
            block[:] = np.cumsum(out[first : last + 1, bpp:], 0, dtype=np.uint8)[1:]
        elif kind in (3, 4):
            _diagonals(out, first, last, bpp, kind)
        elif kind:
            raise ValueError(f"unknown filter {kind}")
    return out[1:, bpp:]


def decode(png: bytes) -> np.ndarray:
    """Samples (height, width, channels) of a PNG; ValueError where a checksum or the structure is wrong."""
    if png[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, header, body, ended = 8, None, [], False
    while at + 12 <= len(png) and not ended:
        n, kind = struct.unpack_from(">I4s", png, at)
        data = png[at + 8 : at + 8 + n]
        if len(data) < n or at + 12 + n > len(png):
            raise ValueError("chunk is cut short")
        if struct.unpack_from(">I", png, at + 8 + n)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise ValueError(f"checksum of {kind!r} is wrong")
        if kind == b"IHDR":
            if len(data) != 13:
                raise ValueError("header of a wrong length")
            header = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
        ended = kind == b"IEND"
        at += 12 + n
    if header is None or not ended:
        raise ValueError("chunks are missing")
    width, height, depth, colour, _, _, interlace = header
    if depth != 8 or colour not in CHANNELS or interlace:
        raise ValueError("only 8-bit images without palette or interlace")
    channels = CHANNELS[colour]
    size = height * (width * channels + 1)
    if not width or not height or size > MOST_BYTES:
        raise ValueError("an image without samples, or of too many")
    inflate = zlib.decompressobj()
    try:
        raw = np.frombuffer(inflate.decompress(b"".join(body), size + 1), np.uint8)
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if raw.size != size or not inflate.eof:
        raise ValueError("wrong number of samples")
    rows = raw.reshape(height, -1)
    return unfilter(rows[:, 0], rows[:, 1:], channels).reshape(height, width, channels)


def _cosines(n: int, keep: int) -> np.ndarray:
    return np.cos(np.pi * np.arange(keep)[:, None] * (2 * np.arange(n) + 1) / (2 * n))


_DCT = _cosines(32, 8)


def _shrunk(plane: np.ndarray, size: int) -> np.ndarray:
    """Means of the rows over `size` equal spans (spans may cut rows)."""
    total = np.concatenate((np.zeros((1, plane.shape[1])), np.cumsum(plane, 0)))
    edge = np.linspace(0, len(plane), size + 1)
    whole = np.minimum(edge.astype(np.int64), len(plane) - 1)
    at = total[whole] + (edge - whole)[:, None] * plane[whole]
    return np.diff(at, axis=0) * (size / len(plane))


def cosine_hash(samples: np.ndarray) -> bytes:
    """8 bytes: signs of the 63 lowest cosine coefficients besides the mean against their median, after shrinking to 32 x 32."""
    plane = samples.astype(np.float64)
    plane = plane.mean(2) if plane.ndim == 3 and plane.shape[2] > 1 else plane.reshape(plane.shape[:2])
    small = _shrunk(_shrunk(plane, 32).T, 32).T
    low = (_DCT @ small @ _DCT.T).ravel()
    low = np.round(low, 6)
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes()


def payload(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length, and the bytes with zeros up to a positive multiple of 64."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def hash_images(df: DataFrame, column: str = "image", out: str = "image_hash") -> DataFrame:
    """df with the 8-byte cosine hash of each PNG; null where the image is null or damaged."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    schema = StructType([*[f for f in df.schema if f.name != out], StructField(out, BinaryType())])

    def one(png):
        try:
            return None if png is None else cosine_hash(decode(png))
        except ValueError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [i for i, n in enumerate(b.schema.names) if n != out]
            got = pa.array([one(x.as_py()) for x in b.column(b.schema.names.index(column))], pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in kept], got], [f.name for f in schema])

    return df.mapInArrow(run, schema)


def store_texts(docs: DataFrame, filters: tuple[int, ...] = (0, 1, 2), level: int = 6) -> DataFrame:
    """doc_id, n_bytes, image (PNG of the padded text, 64 samples a row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, 1000):
                part = b.slice(first, 1000)
                got = [payload(x.as_py()) for x in part.column(1)]
                images = [encode(np.frombuffer(p, np.uint8).reshape(-1, WIDTH), filters, level) for _, p in got]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array(images, pa.binary())], ["doc_id", "n_bytes", "image"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, image binary")


def read_images(images: DataFrame) -> DataFrame:
    """Digests of stored texts, from the stored bytes alone: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, image_hash."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "image_hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column(2):
                png = x.as_buffer()
                png = png.to_pybytes()
                samples = decode(png)
                back = samples.tobytes()
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(samples)))
            cols = list(zip(*rows)) if rows else [()] * 6
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, t) for c, t in zip(cols, types)]], names)

    return images.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, image_hash binary")


def media_digests(docs: DataFrame) -> DataFrame:
    """Every text of docs through the codec and back; equal texts have equal values."""
    got = read_images(store_texts(docs))
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.lower(F.hex("image_hash")).alias("feature"))
