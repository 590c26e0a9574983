"""Elias-Fano sequences and an n-gram trie over them, in one memory-mapped file.

A monotone sequence of n values below u keeps its low l = log2(u / n) bits in a packed array
and its high bits in unary, in a bit vector. All queries work on arrays of arguments.
"""

from __future__ import annotations

import mmap

import numpy as np

U = np.uint64
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Bits:
    """A bit vector with select of zeros and ones by a directory of counts per 64-bit word."""

    def __init__(self, words: np.ndarray, ones: np.ndarray):
        self.words, self.ones = words, ones  # ones[i]: ones before word i

    @staticmethod
    def build(positions: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        words = np.zeros(length // 64 + 2, np.uint64)
        if len(positions):
            at = positions >> 6
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            words[at[first]] = np.bitwise_or.reduceat(U(1) << (positions & 63).astype(np.uint64), first)
        count = _POP[words.view(np.uint8)].reshape(-1, 8).sum(1, dtype=np.uint32)
        return words, np.concatenate((np.zeros(1, np.uint32), np.cumsum(count, dtype=np.uint32)))

    def select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Position of the k-th (from 0) bit of the given value."""
        before = self.ones if bit else (np.arange(len(self.ones), dtype=np.int64) << 6) - self.ones
        word = np.searchsorted(before, k, "right") - 1
        rest = k - before[word].astype(np.int64)
        value = self.words[word] if bit else ~self.words[word]
        place = np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):  # halve the word that holds it
            low = value & U((1 << width) - 1)
            count = _popcount(low)
            up = rest >= count
            rest = np.where(up, rest - count, rest)
            place += np.where(up, width, 0)
            value = np.where(up, value >> U(width), low)
        return (word << 6) + place


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class EliasFano:
    """Monotone values: access by index, and the index of a value."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: Bits):
        self.n, self.l, self.low, self.high = n, low_bits, low, high
        self.lanes = np.ndarray((max(0, low.nbytes - 7),), "<u8", low, strides=(1,))  # eight bytes from each byte on
        self._ones = self._first = None

    @staticmethod
    def build(values: np.ndarray, universe: int) -> list[np.ndarray]:
        """The arrays that `view` takes: (n, l), packed low bits, high words, their counts."""
        n = len(values)
        low_bits = min(56, max(0, (int(universe) // max(n, 1)).bit_length() - 1))
        values = values.astype(np.uint64)
        high = (values >> U(low_bits)).astype(np.int64)
        words, ones = Bits.build(high + np.arange(n), n + (int(universe) >> low_bits) + 2)
        packed = np.zeros(n * low_bits // 64 + 2, np.uint64)
        if low_bits and n:
            low = values & U((1 << low_bits) - 1)
            bit = np.arange(n, dtype=np.int64) * low_bits
            word, shift = bit >> 6, (bit & 63).astype(np.uint64)
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            packed[word[first]] = np.bitwise_or.reduceat(low << shift, first)
            over = np.flatnonzero((bit & 63) + low_bits > 64)  # one at most for each word
            packed[word[over] + 1] |= low[over] >> (U(64) - shift[over])
        return [np.array([n, low_bits], np.int64), packed, words, ones]

    @classmethod
    def view(cls, arrays: list[np.ndarray]) -> EliasFano:
        (n, low_bits), packed, words, ones = arrays
        return cls(int(n), int(low_bits), packed, Bits(words, ones))

    def index(self) -> None:
        """Unpack the high bits for many queries: places of ones, and how many values lie below each bucket of high bits (4 bytes each)."""
        bits = np.unpackbits(self.high.words.view(np.uint8), bitorder="little")
        self._ones = np.flatnonzero(bits).astype(np.uint32 if len(bits) < 1 << 32 else np.int64)
        buckets = (len(bits) - len(self._ones)) + 1
        self._first = np.zeros(buckets + 1, np.int64)
        np.cumsum(np.bincount(self._ones - np.arange(self.n), minlength=buckets), out=self._first[1:])

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.uint64)
        bit = i * self.l
        return (self.lanes[bit >> 3] >> (bit & 7).astype(np.uint64)) & U((1 << self.l) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        at = self.high.select(i, 1) if self._ones is None else self._ones[i].astype(np.int64)
        return ((at - i).astype(np.uint64) << U(self.l)) | self.lows(i)

    def _bucket(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first and last index of the values with the same high bits, index of the first of them that isn't below each value)."""
        bucket = (values >> U(self.l)).astype(np.int64)
        low = values & U((1 << self.l) - 1)
        if self._first is None:
            zeros = (len(self.high.words) << 6) - int(self.high.ones[-1])
            b = np.minimum(bucket, zeros - 1)
            left = np.where(b > 0, self.high.select(np.maximum(b - 1, 0), 0) - (b - 1), 0)
            right = np.where(bucket < zeros, self.high.select(b, 0) - b, self.n)
            left = np.where(bucket < zeros, left, self.n)
        else:
            b = np.minimum(bucket, len(self._first) - 2)
            left, right = self._first[b], self._first[b + 1]
        first, last = left, right
        at = left
        open_ = np.flatnonzero(at < right)
        left, right = at[open_], last[open_]
        at = at.copy()
        while len(open_):
            middle = (left + right) >> 1
            less = self.lows(middle) < low[open_]
            left, right = np.where(less, middle + 1, left), np.where(less, right, middle)
            at[open_] = left
            more = left < right
            open_, left, right = open_[more], left[more], right[more]
        return first, last, at

    def successor(self, values: np.ndarray) -> np.ndarray:
        """Index of the first element not below each value (n if none)."""
        values = np.asarray(values, np.uint64)
        if not self.n or not len(values):
            return np.zeros(len(values), np.int64)
        return self._bucket(values)[2]

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value, -1 if it isn't there: its successor has the same bits, or it is none."""
        values = np.asarray(values, np.uint64)
        if not self.n or not len(values):
            return np.full(len(values), -1, np.int64)
        _, last, at = self._bucket(values)
        there = at < last
        there &= self.lows(np.minimum(at, self.n - 1)) == values & U((1 << self.l) - 1)
        return np.where(there, at, -1)


LEVELS = ("contexts", "words", "pairs", "pair_base", "triples")
CODES = ("contexts", "words", "pairs", "triples")


class Trie:
    """Two- and three-word contexts' words, as context-relative Elias-Fano levels of a memory-mapped file.

    contexts: numbers of the last context words v. words: for each v its words' numbers
    (of `bits` bits), made monotone by v's index. pairs: for each v the words u before it, likewise.
    triples: for each (u, v) its words as ranks among v's words, made monotone by pair_base, the sum
    of word counts up to it. Each level has a table of 8-bit codes (codes: by level).
    """

    def __init__(self, buffer):
        self.buffer = buffer
        count, self.bits = (int(x) for x in np.frombuffer(buffer, np.int64, 2))
        places = np.frombuffer(buffer, np.int64, 2 * count, 16).reshape(-1, 2)
        arrays = []
        kinds = [np.int64, np.uint64, np.uint64, np.uint32] * len(LEVELS) + [np.uint8] * len(CODES)
        for (at, size), kind in zip(places, kinds):
            arrays.append(np.frombuffer(buffer, kind, int(size) // np.dtype(kind).itemsize, int(at)))
        for i, name in enumerate(LEVELS):
            setattr(self, name, EliasFano.view(arrays[4 * i : 4 * i + 4]))
        self.codes = dict(zip(CODES, arrays[4 * len(LEVELS) :]))

    @staticmethod
    def write(file, v: np.ndarray, word_owner: np.ndarray, word: np.ndarray, pair_owner: np.ndarray, pair: np.ndarray, triple_owner: np.ndarray, triple_word: np.ndarray, codes: dict[str, np.ndarray], bits: int) -> None:
        """Levels in order: v; (index of v, word); (index of v, u); (index of pair, index of word). Numbers are below 2 ** bits."""
        n = len(v)
        big = lambda owner, h: (owner.astype(np.uint64) << U(bits)) | h.astype(np.uint64)
        size = np.bincount(word_owner, minlength=n)
        first = np.cumsum(size) - size
        base = np.cumsum(size[pair_owner]) - size[pair_owner] if len(pair) else np.zeros(0, np.int64)
        triples = base[triple_owner] + triple_word - first[pair_owner[triple_owner]] if len(triple_owner) else np.zeros(0, np.int64)
        top = lambda x: int(x[-1]) + 1 if len(x) else 1
        levels = [(v, top(v)), (big(word_owner, word), max(1, n) << bits), (big(pair_owner, pair), max(1, n) << bits), (base, top(base)), (triples, top(triples))]
        arrays = [a for values, universe in levels for a in EliasFano.build(values, universe)]
        arrays += [codes[name].astype(np.uint8) for name in CODES]
        at, places = 16 + 16 * len(arrays), []
        for a in arrays:
            at = -(-at // 64) * 64
            places.append((at, a.nbytes))
            at += a.nbytes
        file.truncate(at)
        file.seek(0)
        file.write(np.array([len(arrays), bits], np.int64).tobytes() + np.array(places, np.int64).tobytes())
        for (place, _), a in zip(places, arrays):
            file.seek(place)
            file.write(np.ascontiguousarray(a).data)
        file.flush()

    @classmethod
    def map(cls, file) -> Trie:
        """The trie in a file that is open for reading, mapped read-only."""
        return cls(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))

    @classmethod
    def open(cls, path: str) -> Trie:
        with open(path, "rb") as f:
            return cls.map(f)

    def index(self) -> None:
        """Make many queries cheap."""
        for name in LEVELS:
            getattr(self, name).index()

    def context(self, v: np.ndarray) -> np.ndarray:
        return self.contexts.find(v)

    def word(self, context: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Index in `words` of each word after its context (an index, -1: none)."""
        return self._after(self.words, context, w)

    def pair(self, context: np.ndarray, u: np.ndarray) -> np.ndarray:
        return self._after(self.pairs, context, u)

    def _after(self, level: EliasFano, owner: np.ndarray, h: np.ndarray) -> np.ndarray:
        if not len(owner) or owner.min() >= 0:
            return level.find((owner.astype(np.uint64) << U(self.bits)) | h.astype(np.uint64))
        out = np.full(len(owner), -1, np.int64)
        known = np.flatnonzero(owner >= 0)
        out[known] = level.find((owner[known].astype(np.uint64) << U(self.bits)) | h[known].astype(np.uint64))
        return out

    def first_word(self, context: np.ndarray) -> np.ndarray:
        """Index of each context's first word."""
        return self.words.successor(np.maximum(context, 0).astype(np.uint64) << U(self.bits))

    def base(self, pair: np.ndarray) -> np.ndarray:
        """Where the words of each pair begin in `triples`."""
        return self.pair_base.access(np.maximum(pair, 0)).astype(np.int64) if self.pair_base.n else np.zeros(len(pair), np.int64)

    def triple(self, pair: np.ndarray, base: np.ndarray, first: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Index in `triples` of a word (an index) after a pair, from the pair's base and its context's first word; -1: none."""
        out = np.full(len(pair), -1, np.int64)
        known = np.flatnonzero((pair >= 0) & (word >= 0))
        out[known] = self.triples.find((base[known] + word[known] - first[known]).astype(np.uint64))
        return out
