"""Vectorised word splitting and hashing over Arrow string columns.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. Words never cross a
document boundary. A word's hash follows from its bytes and length alone: bytes are read in
lanes of eight, each lane goes through a bijective mixer together with what the lanes before
it gave, and words of more than LONG bytes are hashed by BLAKE2b. No sum of powers is taken
anywhere: such sums are equal for some pairs of patterned words, whatever the base.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SPACES = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]
#: Longer words are hashed one by one.
LONG = 64

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@lru_cache(maxsize=1)
def space_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[SPACES] = True
    return table


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


#: Odd factors of the two word hashes and of window hashes.
BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
BASE_C, BASE_D = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Runs of documents (first, last) of about `most` bytes, one document at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the count of words of each document."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    space = space_table()[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([True], space[:-1])) | edge[:n]
    after = np.concatenate((space[1:], [True])) | edge[1:]
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_hashes(column, lower: bool, two: bool = False):
    """(h1, h2 or None, words per document) of a whole column, in bounded scratch memory."""
    raw, offsets = buffers(column)
    one, other, counts = [], [], []
    for first, last in slices(offsets):
        part = raw[offsets[first] : offsets[last]]
        starts, ends, count = spans(part, offsets[first : last + 1] - offsets[first])
        counts.append(count)
        if len(starts):
            h, second = hash_spans(part, starts, ends, lower, two)
            one.append(h)
            other.append(second)
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint64)
    return join(one), join(other) if two else None, np.concatenate(counts) if counts else np.zeros(0, np.int64)


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool, two: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Two independent 64-bit hashes (the second if asked for) of raw[start:end] of each span."""
    size = ends - starts
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = lower_table()[raw] if lower else raw
    lanes = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))  # eight bytes from each place on
    length = size.astype(np.uint64)
    found = [mix(length * U(BASE_A) + U(1))] + ([mix(length * U(BASE_B) + U(1))] if two else [])
    at, rest, who = starts, size, None
    while len(at):
        part = lanes[at] & (U(0xFFFFFFFFFFFFFFFF) >> ((8 - np.minimum(rest, 8)) * 8).astype(np.uint64))
        for h, factor in zip(found, (BASE_A, BASE_B)):
            if who is None:
                h[:] = mix(h ^ (part * U(factor)))
            else:
                h[who] = mix(h[who] ^ (part * U(factor)))
        more = np.flatnonzero(rest > 8)
        who = more if who is None else who[more]
        at, rest = at[more] + 8, rest[more] - 8
        if len(who) and who is not None:
            near = size[who] <= LONG
            who, at, rest = who[near], at[near], rest[near]
    for i in np.flatnonzero(size > LONG).tolist():
        both = hashlib.blake2b(padded[starts[i] : ends[i]].tobytes(), digest_size=16).digest()
        for k, h in enumerate(found):
            h[i] = int.from_bytes(both[8 * k : 8 * k + 8], "little")
    return found[0], found[1] if two else None


def windows(h: np.ndarray, width: int, factor: int) -> np.ndarray:
    """Hash of each run of `width` consecutive values, by doubling; runs may cross documents (see window_ok)."""
    n = len(h) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out, done, block, size = None, 0, h, 1
    while True:  # block: hashes of runs of `size`; out: of runs of `done`
        if width & size:
            out = block if out is None else mix(out[: len(h) - done - size + 1] * U(factor) + block[done : done + len(h) - done - size + 1])
            done += size
        if done == width:
            return out[:n] if width > 1 else mix(out[:n] ^ U(factor))
        block = mix(block[:-size] * U(factor) + block[size:])
        size *= 2


def window_ok(counts: np.ndarray, width: int) -> np.ndarray:
    """True where a window of `width` words that starts there stays in its document."""
    n = int(counts.sum())
    if n < width:
        return np.zeros(0, bool)
    ends = np.repeat(np.cumsum(counts), counts)
    return (np.arange(n) + width <= ends)[: n - width + 1]
