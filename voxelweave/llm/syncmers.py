"""Closed-syncmer fingerprints with positional matching.

A k-byte window is a closed syncmer if the least of the hashes of its s-byte substrings
is at the window's start or end. Whether a window is chosen depends on its own bytes
alone, so a passage gives the same anchors wherever it stands. A fingerprint holds every
anchor of the whole text: a 32-bit hash of the window, and where it starts. Likeness is the share of
all anchors of the two texts that both have, in the same order in both.

Windows of 24 bytes with inner substrings of 8 choose 2 of 17 windows, so a fingerprint takes about
0.6 bytes for each byte of text. Hashes of 32 bits are equal by chance for a share of n / 2**32 of the anchors of a
text that has n others to compare with.

Defined cases: null is the empty text, whose fingerprint has no anchors; a text that has no closed
syncmer (all that are shorter than k) has one anchor, its whole self; two fingerprints without anchors have
likeness 1, one of them 0; the first of equal anchors counts; of rows with equal doc_id the order is that of a hash of
the text, and null doc_ids come last.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import text_bytes
from .text import BASE_A, U, mix

S, K = 8, 24
#: The text that one sort bucket aims at, and the most buckets, so the most rows that the driver reads.
BUCKET_BYTES, MOST_BUCKETS = 2 << 20, 16384


def syncmers(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, byte position) of each closed syncmer, in order of position; of the whole text where it has none."""
    n = len(raw)
    if n >= K:
        data = np.frombuffer(raw, np.uint8)
        words = np.ndarray((n - S + 1,), "<u8", data, strides=(1,))
        h = mix(words)
        span = K - S  # inner substrings start at 0..span
        least, width = h, 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        windows = n - K + 1
        chosen = np.flatnonzero((h[:windows] <= least[1 : windows + 1]) | (h[span : span + windows] <= least[:windows]))
        if len(chosen):
            whole = h[chosen]
            for k in range(S, K, S):
                whole = mix(whole ^ (words[chosen + k] * U(BASE_A)))
            return whole, chosen
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.array([int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")], np.uint64), np.zeros(1, np.int64)


def anchors(raw: bytes) -> np.ndarray:
    """Two columns: the text's distinct anchor hashes (32 bits), and the first position of each, in order of position."""
    h, at = syncmers(raw)
    values = (h >> U(32)).astype(np.uint32)
    first = np.sort(np.unique(values, return_index=True)[1])
    return np.stack((values[first], at[first].astype(np.uint32)), 1)


def to_text(fp: np.ndarray) -> str:
    """Base64 of the hashes, then the gaps of the positions: a byte each, 255 for one that follows in four."""
    gap = np.diff(fp[:, 1].astype(np.int64), prepend=0)
    small = np.minimum(gap, 255).astype(np.uint8)
    return base64.b64encode(np.array([len(fp)], "<u4").tobytes() + fp[:, 0].astype("<u4").tobytes() + small.tobytes() + gap[small == 255].astype("<u4").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    raw = base64.b64decode(text)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    gap = np.frombuffer(raw, np.uint8, n, 4 + 4 * n).astype(np.int64)
    gap[gap == 255] = np.frombuffer(raw, "<u4", offset=4 + 5 * n)
    return np.stack((np.frombuffer(raw, "<u4", n, 4), np.cumsum(gap).astype(np.uint32)), 1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the anchors of both that the two have in the same order of position, 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both, i, j = np.intersect1d(a[:, 0], b[:, 0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    return _rising(j[np.argsort(i)]) / (len(a) + len(b) - len(both))


def _rising(x: np.ndarray) -> int:
    """Length of the longest rising chain of distinct numbers."""
    if (x[1:] > x[:-1]).all():
        return len(x)
    tails: list[int] = []
    for p in x.tolist():
        if not tails or p > tails[-1]:
            tails.append(p)
        else:
            tails[bisect_left(tails, p)] = p
    return len(tails)


def edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _above(bounds: list[int], x: Column) -> Column:
    """How many of the ascending bounds are above x: first among every step-th of them, then among the `step` ahead of that one."""
    step = max(1, int(len(bounds) ** 0.5))
    longs = lambda values: F.array(*[F.lit(int(b)).cast("long") for b in values])
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    later = F.size(F.filter(longs([g[-1] for g in groups]), lambda b: b <= x))  # groups that have no bound above x
    own = F.element_at(F.array(*[longs(g) for g in groups]), F.least(later + 1, F.lit(len(groups))))
    below = F.when(later == len(groups), F.lit(len(bounds))).otherwise(later * step + F.size(F.filter(own, lambda b: b <= x)))
    return F.lit(len(bounds)) - below


def with_next(docs: DataFrame) -> DataFrame:
    """(seq, guard, doc_id, text) sorted so that each row's next document is the row after it, or the guard row that ends its bucket.

    Buckets are ranges of (doc_id, hash of the text) in descending order: quantiles of doc_id, and where one id, or none, fills several buckets, equal
    ranges of the hash. A guard repeats the first document of the next
    bucket that has any. The driver reads one row of ids a bucket, about MOST_BUCKETS at most; texts are shuffled once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    n = max(1, min(MOST_BUCKETS, -(-text_bytes(docs) // BUCKET_BYTES)))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    found = ids.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    bounds = sorted({int(x) for x in found})
    none = ids.agg(F.avg(F.col("doc_id").isNull().cast("double"))).first()[0] or 0.0
    parts = {b: c + 1 for b, c in Counter(map(int, found)).items() if c > 1}
    parts[None] = max(1, round(none * n))
    most = max(parts.values())
    # of the descending hash; an id that fills buckets is the last of its first one
    low = F.lit((1 << 32) - 1) - F.shiftrightunsigned(F.col("tie").bitwiseXOR(F.lit(-(1 << 63))), 32)
    part = lambda k: F.floor(low * k / F.lit(1 << 32)).cast("long")
    bucket = (_above(bounds, F.col("doc_id")) if bounds else F.lit(0)).cast("long") * (most + 1)
    many = [b for b in parts if b is not None]
    if many:
        sizes = F.element_at(F.create_map(*[F.lit(v).cast("long") for b in many for v in (b, parts[b])]), F.col("doc_id"))
        bucket = bucket + F.when(F.col("doc_id").isin(many), 1 + part(sizes)).otherwise(F.lit(0))
    seq = F.when(F.col("doc_id").isNull(), (len(bounds) + 1) * (most + 1) + part(F.lit(parts[None]))).otherwise(bucket)
    tagged = rows.withColumn("seq", seq.cast("long"))
    heads = tagged.groupBy("seq").agg(F.max(F.struct("doc_id", "tie")).alias("head")).select("seq", "head.doc_id", "head.tie").collect()
    heads = sorted((tuple(h) for h in heads), key=lambda h: h[0])
    if not heads:
        return tagged.withColumn("guard", F.lit(0))
    # the first row of each bucket ends the one before it; the very first one ends the last
    ends = docs.sparkSession.createDataFrame([(*h, heads[i - 1][0]) for i, h in enumerate(heads)], "seq long, doc_id long, tie long, target long")
    first = tagged.alias("t").join(F.broadcast(ends.alias("e")), (F.col("t.seq") == F.col("e.seq")) & F.col("t.doc_id").eqNullSafe(F.col("e.doc_id")) & (F.col("t.tie") == F.col("e.tie")))
    guards = first.groupBy("target").agg(F.first("t.doc_id").alias("doc_id"), F.first("t.text").alias("text"), F.first("t.tie").alias("tie")).select("doc_id", "text", "tie", F.col("target").alias("seq"), F.lit(1).alias("guard"))
    parts_ = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 4)
    order = [F.col("seq"), F.col("guard"), F.col("doc_id").desc_nulls_last(), F.col("tie").desc()]
    return tagged.withColumn("guard", F.lit(0)).unionByName(guards).repartition(parts_, "seq").sortWithinPartitions(*order)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next one isn't known yet
        out: list[tuple] = []
        for b in batches:
            columns = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                text, seq = columns["text"][i].as_py(), columns["seq"][i].as_py()
                own = anchors(text.encode())
                if held is not None and held[0] == seq:
                    _, doc_id, before, fp = held
                    changed = edited(before, text)
                    raw = changed.encode()
                    other = anchors(raw)
                    out.append((doc_id, len(before), hashlib.sha256(raw).hexdigest(), to_text(fp), to_text(other), likeness(fp, other), likeness(fp, own)))
                    if len(out) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                        out = []
                held = None if columns["guard"][i].as_py() else (seq, columns["doc_id"][i].as_py(), text, own)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return with_next(docs).select("seq", "guard", "doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
