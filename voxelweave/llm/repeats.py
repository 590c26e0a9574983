"""Exact substring dedup: words covered by a window of 35 that also starts elsewhere.

1. Each chunk of documents sends a sketch of its distinct windows: their cells in the rows of a
count-min sketch, as sorted gaps. Blocks of cells add up the sketches of all chunks
and tell each chunk which of its cells have a count over one. The sketch never
underestimates, so no repeated window is lost. Its width follows the input's size.
2. Windows whose least estimate is over one are sent on as 96-bit hashes; each bucket of hashes
groups them exactly and tells each chunk which of its windows start in another chunk too.
3. With those and its own repeats each chunk cuts the covered words out of the text: each run of
them with the blanks on one side. All else, line feeds and blanks too, stays as it is.

Windows are judged on the input, all occurrences alike. Hashes of 96 bits decide equality.

Defined cases: null text has no words and stays null; documents under 35 words keep
all of them; equal rows repeat each other; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .chunks import chunked, grown, log2_up
from .scratch import named, text_bytes
from .text import BASE_C, BASE_D, U, mix, window_ok, windows, word_hashes

WIDTH, SKETCH_ROWS, BLOCK_BITS = 35, 2, 22
WORD, SPACES = re.compile(rb"[^\x20\x09-\x0D]+"), "[\\x20\\x09-\\x0D]+"
SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)


def gaps(cells: np.ndarray) -> bytes:
    """Sorted cells as gaps of 1, 2 (in two planes) or 4 bytes."""
    d = np.diff(cells, prepend=0)
    most = int(d.max()) if len(d) else 0
    if most < 1 << 8:
        return b"\x01" + d.astype(np.uint8).tobytes()
    if most < 1 << 16:
        return b"\x02" + (d & 255).astype(np.uint8).tobytes() + (d >> 8).astype(np.uint8).tobytes()
    return b"\x04" + d.astype("<u4").tobytes()


def ungaps(raw: bytes) -> np.ndarray:
    body = np.frombuffer(raw, np.uint8, offset=1)
    if raw[0] == 1:
        d = body.astype(np.int64)
    elif raw[0] == 2:
        half = len(body) // 2
        d = body[:half].astype(np.int64) | body[half:].astype(np.int64) << 8
    else:
        d = body.view("<u4").astype(np.int64)
    return np.cumsum(d)


class Windows:
    """A chunk's windows: which words start one, and their distinct hashes."""

    def __init__(self, table: pa.Table, width: int):
        one, two, self.counts = word_hashes(table["text"], lower=False, two=True)
        self.ok = window_ok(self.counts, width)
        first = windows(one, width, BASE_C)[self.ok]
        second = (windows(two, width, BASE_D)[self.ok] >> U(32)).astype(np.uint32)
        self.order = np.argsort(first)
        h, rest = first[self.order], second[self.order]
        same = h[1:] == h[:-1]
        if (same & (rest[1:] != rest[:-1])).any():  # equal in 64 bits, not in 96
            self.order = np.lexsort((second, first))
            h, rest = first[self.order], second[self.order]
            same = h[1:] == h[:-1]
        new = np.ones(len(h), bool)
        new[1:] = ~(same & (rest[1:] == rest[:-1]))
        self.starts = np.flatnonzero(new)
        self.distinct, self.second = h[self.starts], rest[self.starts]
        self.here = np.diff(np.append(self.starts, len(h)))

    def places(self, h: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Where windows of this chunk stand among its distinct ones."""
        at = np.searchsorted(self.distinct, h)
        while (off := self.second[at] != second).any():
            at[off] += 1
        return at

    def cells(self, row: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted cells in a sketch row, and the windows they belong to."""
        cell = (mix(self.distinct ^ U(SEEDS[row])) >> U(64 - bits)).astype(np.int64)
        order = np.argsort(cell)
        return cell[order], order


def _blocks(cells: np.ndarray, block_bits: int):
    """(block, first, last) of the runs of sorted cells."""
    block = cells >> block_bits
    cut = np.flatnonzero(np.diff(block)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(cells)]):
        if b > a:
            yield int(block[a]), a, b


def _keys(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The 64 and the 32 bits of each window in a message."""
    n = len(raw) // 12
    return np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<u4", n, 8 * n)


def _frame(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


def cut(text: str, kept: np.ndarray) -> str:
    """A text without the runs of words that aren't kept. Of the blanks on a run's two sides those with more line feeds stay, the first if equal, and at the ends of the text the outer ones."""
    raw, out, at = text.encode(), [], 0
    spans = [m.span() for m in WORD.finditer(raw)]
    edges = np.diff(np.concatenate(([True], kept, [True])).astype(np.int8))
    for first, after in zip(np.flatnonzero(edges < 0).tolist(), np.flatnonzero(edges > 0).tolist()):
        start, end = spans[first][0], spans[after - 1][1]
        left = spans[first - 1][1] if first else 0
        right = spans[after][0] if after < len(spans) else len(raw)
        if first and (after == len(spans) or raw.count(b"\n", end, right) > raw.count(b"\n", left, start)):
            start = left
        else:
            end = right
        out.append(raw[at:start])
        at = end
    return b"".join([*out, raw[at:]]).decode()


SENT = pa.schema([("bucket", pa.int64()), ("chunk", pa.int32()), ("payload", pa.binary())])
SENT_SQL = "bucket long, chunk int, payload binary"


def remove_repeats(docs: DataFrame, width: int = WIDTH, rows: int = SKETCH_ROWS, sketch_bits: int | None = None, keep: list[str] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, text (unchanged but for the words that were cut out), and the columns of keep in a struct `rest`, as c0, c1 and so on."""
    size = max(1, text_bytes(docs))
    bits = sketch_bits or min(48, max(16, log2_up(size)))
    block_bits = min(BLOCK_BITS + log2_up(grown(size, 1 << 22, 1 << 24) >> 22), bits)
    blocks, bucket_bits = bits - block_bits, max(1, log2_up(size // grown(size, 1 << 22, 1 << 25)))
    rest = F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(keep)], F.lit(0).alias("none")).alias("rest")
    texts = chunked(docs, [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rest], size)

    def sketch(table: pa.Table) -> pa.Table:
        own, out = Windows(table, width), []
        chunk = table["chunk"][0].as_py()
        for r in range(rows):
            cells, _ = own.cells(r, bits)
            out += [((r << blocks) + b, chunk, gaps(cells[i:j] & ((1 << block_bits) - 1))) for b, i, j in _blocks(cells, block_bits)]
        return _frame(out, SENT)

    def add_up(table: pa.Table) -> pa.Table:
        total, out = np.zeros(1 << block_bits, np.uint8), []
        for raw in table["payload"]:
            cells, n = np.unique(ungaps(raw.as_py()), return_counts=True)
            total[cells] = np.minimum(total[cells] + np.minimum(n, 2), 2)
        bucket = table["bucket"][0].as_py()
        for chunk, raw in zip(table["chunk"].to_pylist(), table["payload"]):
            out.append((bucket, chunk, np.packbits(total[ungaps(raw.as_py())] > 1).tobytes()))
        return _frame(out, SENT)

    def candidates(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _frame([], SENT)
        own, chunk = Windows(table, width), table["chunk"][0].as_py()
        flags = dict(zip(told["bucket"].to_pylist(), told["payload"]))
        repeated = np.ones(len(own.distinct), bool)
        for r in range(rows):
            cells, order = own.cells(r, bits)
            for b, i, j in _blocks(cells, block_bits):
                raw = np.frombuffer(flags[(r << blocks) + b].as_py(), np.uint8)
                repeated[order[i:j]] &= np.unpackbits(raw, count=j - i).astype(bool)
        h, second, out = own.distinct[repeated], own.second[repeated], []
        for b, i, j in _blocks((h >> U(1)).astype(np.int64), 63 - bucket_bits):
            out.append((b, chunk, h[i:j].astype("<u8").tobytes() + second[i:j].astype("<u4").tobytes()))
        return _frame(out, SENT)

    def group(table: pa.Table) -> pa.Table:
        keys = [_keys(x.as_py()) for x in table["payload"]]
        sizes = np.array([len(x) for x, _ in keys])
        h, second = (np.concatenate(x) for x in zip(*keys))
        order = np.lexsort((second, h))
        same = (h[order][1:] == h[order][:-1]) & (second[order][1:] == second[order][:-1])
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        bucket, out, at = table["bucket"][0].as_py(), [], 0
        for chunk, n in zip(table["chunk"].to_pylist(), sizes.tolist()):
            found = np.flatnonzero(twice[at : at + n]) + at
            if len(found):
                out.append((bucket, chunk, h[found].astype("<u8").tobytes() + second[found].astype("<u4").tobytes()))
            at += n
        return _frame(out, SENT)

    result = docs.sparkSession.createDataFrame([], "doc_id long, n_words long, n_removed long, text string").schema.add("rest", texts.schema["rest"].dataType)

    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        own = Windows(table, width)
        repeated = own.here > 1
        for raw in told["payload"]:
            h, second = _keys(raw.as_py())
            repeated[own.places(h, second)] = True
        # words covered by a repeated window
        change = np.zeros(int(own.counts.sum()) + 1, np.int32)
        hit = np.zeros(len(own.order), bool)
        hit[own.order] = np.repeat(repeated, own.here)
        at = np.flatnonzero(own.ok)[hit]
        change[at] += 1
        change[at + width] -= 1
        kept = np.cumsum(change[:-1]) == 0
        ends = np.cumsum(own.counts)
        texts, removed = [], []
        for raw, a, b in zip(table["text"], ends - own.counts, ends):
            text, mask = raw.as_py(), kept[a:b]
            removed.append(int(b - a - mask.sum()))
            texts.append(cut(text, mask) if removed[-1] else text)
        return pa.Table.from_arrays([table["doc_id"], pa.array(own.counts.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(texts, pa.string()), table["rest"]], ["doc_id", "n_words", "n_removed", "text", "rest"])

    flagged = texts.groupBy("chunk").applyInArrow(sketch, SENT_SQL).groupBy("bucket").applyInArrow(add_up, SENT_SQL)
    sent = texts.groupBy("chunk").cogroup(flagged.groupBy("chunk")).applyInArrow(candidates, SENT_SQL)
    told = sent.groupBy("bucket").applyInArrow(group, SENT_SQL)
    return texts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(finish, result)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs without the repeated words in text, and n_chars, if there, its length."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    got = remove_repeats(docs, keep=others)
    columns = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text")}
    return got.select(*[(columns[c].cast(docs.schema[c].dataType) if c in columns else F.col("rest").getField(f"c{others.index(c)}")).alias(c) for c in docs.columns])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space)."""
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), SPACES, " "))
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))
