"""Byte codecs of unsigned integer columns, with numpy, and their grouped DataFrame forms.

Encoders and bitunpack are vectorised. The other decoders find for all bit positions at once where a code
that starts there would end, walk from code to code, and read all values at once.

Streams are (meta, data). bitpack and rice are least significant bit first with meta of a 32-bit
count and one byte of width or k; huffman and exp-Golomb are most significant bit first. Huffman
codes are canonical, with lengths of 32 at most. An empty column has empty streams.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

MOST_LENGTH = 32
PATCH = 254
#: The share of its packed data that a codebook of counts may cost.
META_SHARE = 0.25


def _bits_of(values: np.ndarray, lengths: np.ndarray, big_end: bool) -> np.ndarray:
    """All values' bits in a row, `lengths` bits each: a byte a bit, made in runs of some values."""
    ends = np.cumsum(lengths)
    out, first = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8), 0
    while first < len(values):
        done = int(ends[first] - lengths[first])
        last = max(first + 1, int(np.searchsorted(ends, done + (1 << 20), "right")))
        n = lengths[first:last]
        row = np.repeat(np.arange(first, last), n)
        at = np.arange(len(row)) - np.repeat(ends[first:last] - n - done, n)
        shift = (lengths[row] - 1 - at) if big_end else at
        out[done : done + len(row)] = values[row] >> shift.astype(np.uint64) & np.uint64(1)
        first = last
    return out


def _read(data: bytes, at: np.ndarray, n: int | np.ndarray, big_end: bool) -> np.ndarray:
    """Numbers of n (0 to 64) bits from bit positions on; beyond the end there are zeros."""
    raw = np.frombuffer(data + bytes(9), np.uint8)
    byte, bit = np.minimum(at >> 3, len(data)), (at & 7).astype(np.uint64)
    rest = np.uint64(8) - bit
    lane = np.ndarray((len(raw) - 8,), ">u8" if big_end else "<u8", raw, strides=(1,))[byte].astype(np.uint64)
    after = raw[byte + 8].astype(np.uint64)
    n = np.asarray(n, np.uint64)
    over = np.where(n > 0, np.uint64(64) - n, np.uint64(0))
    if big_end:
        return np.where(n > 0, ((lane << bit) | (after >> rest)) >> over, np.uint64(0))
    whole = (lane >> bit) | np.where(bit > 0, after << (np.uint64(64) - np.maximum(bit, np.uint64(1))), np.uint64(0))
    return np.where(n > 0, whole << over >> over, np.uint64(0))


def _walk(following: np.ndarray, n: int) -> np.ndarray:
    """The first n positions from 0 on, each the one that follows the one before; the last code must end within the bits."""
    out = np.zeros(n, np.int64)
    steps, places, at, most = memoryview(following), memoryview(out), 0, len(following)
    for i in range(n):
        if at >= most:
            raise ValueError("stream is cut short")
        places[i] = at
        at = steps[at]
    if at > most:
        raise ValueError("stream is cut short")
    return out


def _next_of(bits: np.ndarray, value: int) -> np.ndarray:
    """For each position the next one whose bit has the value; without one, a place far beyond the end."""
    at = np.where(bits == value, np.arange(len(bits)), np.int64(1) << 40)
    return np.minimum.accumulate(at[::-1])[::-1]


def _width(values: np.ndarray) -> int:
    return max(1, int(values.max()).bit_length())


def bitpack(values: np.ndarray) -> tuple[bytes, bytes]:
    values = values.astype(np.uint64)
    if not len(values):
        return b"", b""
    w = _width(values)
    bits = _bits_of(values, np.full(len(values), w), False)
    return struct.pack("<IB", len(values), w), np.packbits(bits, bitorder="little").tobytes()


def bitunpack(meta: bytes, data: bytes) -> np.ndarray:
    if not meta:
        return np.zeros(0, np.uint64)
    n, w = struct.unpack("<IB", meta)
    if n * w > 8 * len(data):
        raise ValueError("stream is cut short")
    return _read(data, np.arange(n, dtype=np.int64) * w, w, False)


def rice_parameter(values: np.ndarray) -> int:
    mean = float(values.mean()) if len(values) else 0.0
    return min(62, int(np.floor(np.log2(mean)))) if mean >= 1 else 0


def rice(values: np.ndarray) -> tuple[bytes, bytes]:
    """Golomb-Rice: the quotient in ones and a zero, then k bits."""
    values = values.astype(np.uint64)
    if not len(values):
        return b"", b""
    k = rice_parameter(values)
    ones = (values >> np.uint64(k)).astype(np.int64)
    size = ones + 1 + k
    start = np.cumsum(size) - size
    bits = np.zeros(int(size.sum()), np.uint8)
    at = np.arange(len(bits)) - np.repeat(start, size)
    row = np.repeat(np.arange(len(values)), size)
    bits[at < ones[row]] = 1
    low = at > ones[row]
    bits[low] = (values[row[low]] >> (at[low] - ones[row[low]] - 1).astype(np.uint64) & np.uint64(1)).astype(np.uint8)
    return struct.pack("<IB", len(values), k), np.packbits(bits, bitorder="little").tobytes()


def unrice(meta: bytes, data: bytes) -> np.ndarray:
    if not meta:
        return np.zeros(0, np.uint64)
    n, k = struct.unpack("<IB", meta)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    stops = _next_of(bits, 0)
    start = _walk(stops + 1 + k, n)
    stop = stops[start]
    return ((stop - start).astype(np.uint64) << np.uint64(k)) + _read(data, stop + 1, k, False)


def exp_golomb_order(values: np.ndarray) -> int:
    """The order of 0 to 16 with the least bits, the smallest of equals."""
    return int(np.argmin([_exp_bits(values, k).sum() for k in range(17)])) if len(values) else 0


def _lengths(v: np.ndarray) -> np.ndarray:
    """Bit lengths of positive values."""
    v = v.astype(np.uint64)
    high = v >> np.uint64(32)
    # halves are exact as doubles
    return np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], np.frexp((v & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]).astype(np.int64)


def _exp_bits(values: np.ndarray, k: int) -> np.ndarray:
    return 2 * _lengths((values >> np.uint64(k)) + np.uint64(1)) - 1 + k


def exp_golomb(values: np.ndarray) -> tuple[bytes, bytes]:
    values = values.astype(np.uint64)
    if not len(values):
        return b"", b""
    k = exp_golomb_order(values)
    head = (values >> np.uint64(k)) + np.uint64(1)
    n = _lengths(head)
    # n - 1 zeros, the head's n bits, then k low bits
    code = head << np.uint64(k) | values & np.uint64((1 << k) - 1)
    return struct.pack("<IB", len(values), k), np.packbits(_bits_of(code, 2 * n - 1 + k, True)).tobytes()


def unexp_golomb(meta: bytes, data: bytes) -> np.ndarray:
    if not meta:
        return np.zeros(0, np.uint64)
    n, k = struct.unpack("<IB", meta)
    ones = _next_of(np.unpackbits(np.frombuffer(data, np.uint8)), 1)
    start = _walk(2 * ones - np.arange(len(ones)) + 1 + k, n)
    one = ones[start]
    code = _read(data, one, one - start + 1 + k, True)
    return ((code >> np.uint64(k)) - np.uint64(1) << np.uint64(k)) | (code & np.uint64((1 << k) - 1))


def code_lengths(freq: dict[int, int], most: int = MOST_LENGTH) -> dict[int, int]:
    """Huffman code lengths; frequencies are halved until none is over `most`. A single symbol has length 1."""
    if len(freq) == 1:
        return {s: 1 for s in freq}
    while True:
        heap = [(f, s, (s,)) for s, f in sorted(freq.items())]
        heapq.heapify(heap)
        length = dict.fromkeys(freq, 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                length[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if not length or max(length.values()) <= most:
            return length
        freq = {s: f // 2 + 1 for s, f in freq.items()}


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """(code, length) of each symbol: codes count up in order of length, then symbol."""
    out, code, last = {}, 0, 0
    for symbol, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - last
        out[symbol], last = (code, n), n
        code += 1
    return out


def codebook(values: np.ndarray) -> dict[int, tuple[int, int]]:
    symbols, freq = np.unique(values, return_counts=True)
    return canonical(code_lengths(dict(zip(symbols.tolist(), freq.tolist())))) if len(values) else {}


def save_codebook(book: dict[int, tuple[int, int]]) -> bytes:
    """Count, then for each symbol 8 bytes, a byte of length; codes follow from the lengths."""
    return struct.pack(">I", len(book)) + b"".join(struct.pack(">QB", s, n) for s, (_, n) in sorted(book.items()))


def load_codebook(raw: bytes) -> dict[int, tuple[int, int]]:
    n = struct.unpack_from(">I", raw)[0]
    return canonical({s: length for s, length in struct.iter_unpack(">QB", raw[4 : 4 + 9 * n])})


def huffman(values: np.ndarray, book: dict[int, tuple[int, int]] | None = None) -> tuple[bytes, bytes]:
    """Streams under the column's own codebook, or under a shared one, which then isn't in the meta."""
    values = values.astype(np.uint64)
    if not len(values):
        return b"", b""
    own = codebook(values) if book is None else book
    symbols, place = np.unique(values, return_inverse=True)
    missing = [s for s in symbols.tolist() if s not in own]
    if missing:
        raise ValueError(f"symbols without a code: {missing[:5]}")
    code = np.array([own[s][0] for s in symbols.tolist()], np.uint64)[place]
    size = np.array([own[s][1] for s in symbols.tolist()], np.int64)[place]
    meta = struct.pack("<I", len(values)) + (save_codebook(own) if book is None else b"")
    return meta, np.packbits(_bits_of(code, size, True)).tobytes()


def unhuffman(meta: bytes, data: bytes, book: dict[int, tuple[int, int]] | None = None) -> np.ndarray:
    if not meta:
        return np.zeros(0, np.uint64)
    n = struct.unpack_from("<I", meta)[0]
    own = load_codebook(meta[4:]) if book is None else book
    # canonical codes, put at the top of 32 bits, ascend with their lengths
    ordered = sorted((code << (MOST_LENGTH - size), size, s) for s, (code, size) in own.items())
    top, size, symbol = (np.array(c, np.uint64) for c in zip(*ordered))
    ahead = _read(data, np.arange(8 * len(data), dtype=np.int64), MOST_LENGTH, True)
    first = np.flatnonzero(np.concatenate(([True], size[1:] != size[:-1])))
    length = size[first][np.searchsorted(top[first], ahead, "right") - 1].astype(np.int64)
    start = _walk(np.arange(len(ahead)) + length, n)
    place = np.searchsorted(top, ahead[start], "right") - 1
    if ((ahead[start] - top[place]) >> (np.uint64(MOST_LENGTH) - size[place])).any():
        raise ValueError("bits that are no code")
    return symbol[place]


def entropy(values: np.ndarray) -> float:
    f = np.unique(values, return_counts=True)[1] / max(len(values), 1)
    return float(-(f * np.log2(f)).sum())


def counts_code(n: int, kinds: int, width: int) -> str:
    """Which code n counts of `kinds` values, the greatest of `width` bits, take: exp-Golomb if a codebook costs over META_SHARE of the packed data."""
    return "exp-golomb" if 4 + 9 * kinds > META_SHARE * -(-n * width // 8) else "huffman"


def counts_stream(values: np.ndarray) -> tuple[str, bytes, bytes]:
    """(code, meta, data) under the code that counts_code gives."""
    code = counts_code(len(values), len(np.unique(values)), _width(values)) if len(values) else "huffman"
    return code, *ENCODERS[code](values)


def zstd(raw: bytes, level: int = 3) -> bytes:
    """The length in 8 bytes, then a zstd frame."""
    return struct.pack("<Q", len(raw)) + pa.Codec("zstd", compression_level=level).compress(raw, asbytes=True)


def unzstd(raw: bytes) -> bytes:
    n = struct.unpack_from("<Q", raw)[0]
    got = pa.Codec("zstd").decompress(raw[8:], n, asbytes=True)
    if len(got) != n:
        raise ValueError("wrong size after inflating")
    return got


ENCODERS: dict[str, Callable] = {"bitpack": bitpack, "rice": rice, "exp-golomb": exp_golomb, "huffman": huffman}
DECODERS: dict[str, Callable] = {"bitpack": bitunpack, "rice": unrice, "exp-golomb": unexp_golomb, "huffman": unhuffman}


def encode_groups(df: DataFrame, by: str, order: str, value: str, code: str) -> DataFrame:
    """by, n, meta, data: each group's values in order, in one stream. Groups are bounded chunks or parts."""
    encode = ENCODERS[code]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values(order)[value].to_numpy(np.uint64)
        meta, data = encode(values)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "n": [len(values)], "meta": [meta], "data": [data]})

    kind = dict(df.dtypes)[by]
    return df.select(by, order, value).groupBy(by).applyInPandas(run, f"{by} {kind}, n long, meta binary, data binary")


def decode_groups(streams: DataFrame, by: str, code: str) -> DataFrame:
    """by, position (from 0), value of every stream of encode_groups."""
    decode = DECODERS[code]
    kind = dict(streams.dtypes)[by]

    def run(batches):
        for pdf in batches:
            for key, meta, data in zip(pdf[by], pdf["meta"], pdf["data"]):
                values = decode(bytes(meta), bytes(data)).astype(np.int64)
                yield pd.DataFrame({by: np.full(len(values), key), "position": np.arange(len(values)), "value": values})

    return streams.select(by, "meta", "data").mapInPandas(run, f"{by} {kind}, position long, value long")
