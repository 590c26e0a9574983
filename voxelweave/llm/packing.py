"""Tokenizing documents and packing their pieces into sequences by bounded-space online best-fit.

Tokenizing: texts are cut into the byte-level BPE's pre-tokens by numpy over code point
classes; a bounded cache, keyed by the pre-tokens' bytes, keeps the ids of those met before.

Packing: pieces come in an order set by a hash. Each goes to the open bin with the
least free space that holds it; a bitset over free space finds that bin. Where more
than `open_bins` bins are open, the fullest is closed. Each task packs its own pieces.

Defined cases: null text is empty and packs as the end id alone; special tokens'
strings in a text are ordinary text; equal rows are packed each for itself; an empty
table gives an empty result. A table's pieces are spread by hash over tasks of about
`GROUP_BYTES` of input, so each task leaves a bounded count of bins part full.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .scratch import text_bytes

SEQUENCE, END, OPEN_BINS = 2048, 0, 512
GROUP_BYTES = 64 << 20
BATCH_CHARS = 1 << 20
#: The cache is emptied beyond so many pre-tokens or bytes of them.
CACHE_ENTRIES, CACHE_BYTES = 300_000, 16 << 20
#: Code points with the property White_Space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE] = SPACE
    return table


def pretoken_starts(cps: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Where the pre-tokens start in concatenated texts; docs: where non-empty texts start."""
    n = len(cps)
    kind = classes()[cps]
    first = np.zeros(n + 1, bool)
    first[docs] = True
    first[n] = True
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(start)
    ends = np.append(runs[1:], n)
    white = kind[runs] == SPACE
    # a white run's last character, where text follows, stands alone or, a blank, with what follows
    led = white & ~first[ends]
    last = ends[led] - 1
    start[last] = True
    start[ends[led][cps[last] == 0x20]] = False
    # 's 't 're 've 'm 'll 'd, where the apostrophe starts a token
    quote = runs[(cps[runs] == 39) & (ends - runs == 1) & ~first[ends]]
    quote = quote[start[quote]]
    if len(quote):
        nxt = cps[quote + 1]
        after = np.where((quote + 2 < n) & ~first[np.minimum(quote + 2, n)], cps[np.minimum(quote + 2, n - 1)], 0)
        one = np.isin(nxt, [ord(c) for c in "stmd"])
        two = ((nxt == ord("r")) & (after == ord("e"))) | ((nxt == ord("v")) & (after == ord("e"))) | ((nxt == ord("l")) & (after == ord("l")))
        for hit, length in ((one, 2), (two, 3)):
            at = quote[hit]
            start[at + 1] = False
            rest = at + length
            start[rest[rest < n]] = True
    return np.flatnonzero(start)


class Slots(dict):
    """Places of pre-tokens' ids by the pre-tokens' bytes; one that is new is encoded and gets the next place."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.ids, self.bytes = encode, [], 0

    def __missing__(self, piece: bytes) -> int:
        self.ids.append(self.encode(piece))
        self.bytes += len(piece)
        self[piece] = place = len(self.ids) - 1
        return place


class Encoder:
    """Ids of texts by a byte-level BPE whose ranks lie in a tokenizers JSON file."""

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        # byte-level files write each byte as a printable character
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(back[c] for c in token): i for token, i in vocabulary.items() if all(c in back for c in token)}
        ranks = {t: i for t, i in ranks.items() if t != b"<|endoftext|>"}
        self.core = tiktoken.Encoding("packing", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.clear()

    def clear(self) -> None:
        """Empty the cache: places of pre-tokens, and where the ids of each place lie in `flat`."""
        self.slots = Slots(self.core.encode_single_piece)
        self.at, self.sizes, self.flat, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.uint32), 0

    def learned(self) -> None:
        """Move the ids that the cache has got since the last call to `flat`."""
        got = self.slots.ids[len(self.sizes) :]
        if not got:
            return
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        new = np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum()))
        self.slots.ids[len(self.sizes) :] = [None] * len(got)
        if self.used + len(new) > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.used], np.zeros(self.used + 2 * len(new), np.uint32)))
        self.flat[self.used : self.used + len(new)] = new
        self.sizes = np.concatenate((self.sizes, sizes))
        self.at = np.concatenate((self.at, self.used + np.cumsum(sizes) - sizes))
        self.used += len(new)

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids start and end."""
        whole = "".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        if not whole:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        cps = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        starts = pretoken_starts(cps, (ends - lengths)[lengths > 0])
        raw = whole.encode()
        if len(raw) == len(cps):
            edges = np.append(starts, len(raw)).tolist()
        else:
            width = 1 + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000)
            edges = np.append((np.cumsum(width) - width)[starts], len(raw)).tolist()
        if len(self.slots) > CACHE_ENTRIES or self.slots.bytes > CACHE_BYTES:
            self.clear()
        slot = np.fromiter(map(self.slots.__getitem__, [raw[a:b] for a, b in zip(edges, edges[1:])]), np.int64, len(starts))
        self.learned()
        each, offsets = self.sizes[slot], self.at[slot]
        total = np.cumsum(each)
        ids = self.flat[np.repeat(offsets - (total - each), each) + np.arange(int(total[-1]))]
        bounds = np.concatenate(([0], total))[np.searchsorted(starts, np.concatenate(([0], ends)))]
        return ids, bounds


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(n: int, most: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole if it fits, else full pieces after one of the rest."""
    first = n % most or most
    return [(0, first), *((s, most) for s in range(first, n, most))]


def pieces(docs: DataFrame, tokenizer: str, most: int = SEQUENCE, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's ids and end id; ids themselves if asked of Encoder."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            doc_ids, texts = b.column(0), b.column(1)
            first = 0
            while first < b.num_rows:
                group, size, last = [], 0, first
                while last < b.num_rows and (not group or size < BATCH_CHARS):
                    group.append(texts[last].as_py() or "")
                    size += len(group[-1])
                    last += 1
                ids, bounds = enc.batch(group)
                out = []
                for i, d in enumerate(doc_ids.slice(first, last - first).to_pylist()):
                    raw = np.append(ids[bounds[i] : bounds[i + 1]], end).astype("<u4")
                    out += [(d, k, s, n, zlib.crc32(raw[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(raw), most))]
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "piece" else pa.int64()) for c, n in zip(columns, names)], names)
                first = last

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class BestFit:
    """Open bins keyed by free space. add() returns (bin, offset)."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.open_bins, self.open, self.made, self.bits = size, open_bins, 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            which = self._take(free)
        else:
            free, which = self.size, self.made
            self.made += 1
        rest = free - length
        if rest:
            self.bins[rest].append(which)
            self.bits |= 1 << rest
            self.open += 1
            if self.open > self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return which, self.size - free

    def _take(self, free: int) -> int:
        held = self.bins[free]
        which = held.pop()
        if not held:
            self.bits ^= 1 << free
        self.open -= 1
        return which


def pack(rows: DataFrame, groups: int, most: int = SEQUENCE, open_bins: int = OPEN_BINS) -> DataFrame:
    """rows (with doc_id, piece, length) plus sequence_id and offset; each of `groups` tasks packs for itself."""
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*rows.schema, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = BestFit(most, open_bins), TaskContext.get().partitionId() << 40
        for b in batches:
            if b.num_rows:
                got = [packer.add(n) for n in b.column(b.schema.names.index("length")).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([base + w for w, _ in got], pa.int64()), pa.array([o for _, o in got], pa.int64())], [f.name for f in schema])

    # by all columns, so that rows without a doc_id are dealt out too
    dealt = rows.repartition(max(1, groups), *rows.columns)
    return dealt.sortWithinPartitions(F.xxhash64(*rows.columns), *rows.columns).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of every document."""
    return pack(pieces(docs, tokenizer), -(-text_bytes(docs) // GROUP_BYTES))
