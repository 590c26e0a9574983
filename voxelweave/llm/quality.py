"""Document quality by histogram gradient-boosted trees over document statistics.

Statistics are taken from the text alone, with numpy over whole Arrow batches. Trees are
grown level by level on quantile bins with second-order logistic gradients, then
flattened into arrays (complete binary trees in heap order), which a batch of rows
traverses together. Training runs on the driver over a bounded sample
(labelled.SAMPLE_ROWS rows of some 30 numbers); scoring reads every whole text.

Defined cases: null text is the empty text, whose statistics are all 0; without labelled
rows every score is 0.5, with one class only the score is that class's smoothed share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .labelled import held_out, sample
from .text import BASE_A, U, buffers, hash_spans, mix, slices, spans

#: Classes of bytes; all else is 0.
CLASSES = [
    [0x20], [0x0A], [0x09, 0x0B, 0x0C, 0x0D], list(range(97, 123)), list(range(65, 91)), list(range(48, 58)),
    list(b".,;:"), list(b"!?"), list(b"|"), list(b"#$%&*@^~+"), list(b"<>{}[]()/\\=_"), list(b"'\"`-"), list(range(0xC0, 0x100)), list(range(0x80, 0xC0)),
]
N_CLASSES = len(CLASSES) + 1
_CLASS = np.zeros(256, np.uint8)
for _i, _c in enumerate(CLASSES):
    _CLASS[_c] = _i + 1
FEATURES = N_CLASSES + 18


def _per(doc: np.ndarray, n: int, weights=None) -> np.ndarray:
    return np.bincount(doc, weights, n).astype(np.float64)


def _distinct(keys: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each document, and the count of its most frequent one."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    first = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (d[1:] != d[:-1]))))
    most = np.zeros(n)
    np.maximum.at(most, d[first], np.diff(np.append(first, len(k))))
    return _per(d[first], n), most


def statistics(column) -> np.ndarray:
    """One row of FEATURES numbers for each text."""
    raw, offsets = buffers(column)
    out = [np.zeros((0, FEATURES))]
    for first, last in slices(offsets):
        out.append(_statistics(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]))
    return np.concatenate(out)


def _statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    table = np.zeros((n, FEATURES))
    if not len(raw):
        return table
    doc = np.repeat(np.arange(n), np.diff(offsets))
    table[:, :N_CLASSES] = np.bincount(doc * N_CLASSES + _CLASS[raw], minlength=n * N_CLASSES).reshape(n, -1) / np.maximum(size, 1)[:, None]
    starts, ends, counts = spans(raw, offsets)
    words = np.maximum(counts, 1).astype(np.float64)
    more = [np.log1p(size), np.log1p(counts)]
    if len(starts):
        owner = np.repeat(np.arange(n), counts)
        h, _ = hash_spans(raw, starts, ends, False)
        length = ends - starts
        mean = _per(owner, n, length) / words
        more += [mean, np.sqrt(np.maximum(_per(owner, n, length.astype(np.float64) ** 2) / words - mean**2, 0))]
        more += [_per(owner, n, length <= 3) / words, _per(owner, n, length > 14) / words]
        distinct, most = _distinct(h, owner, n)
        more += [distinct / words, most / words, distinct / np.sqrt(words)]
        same = np.flatnonzero((h[1:] == h[:-1]) & (owner[1:] == owner[:-1]))
        more.append(_per(owner[same], n) / words)
        pair = np.flatnonzero(owner[1:] == owner[:-1])
        more.append(_distinct(mix(h[pair] * U(BASE_A) + h[pair + 1]), owner[pair], n)[0] / words)
        last = _CLASS[raw[ends - 1]]
        more += [_per(owner, n, last == k) / words for k in (7, 8, 10)]
        upper = _CLASS[raw[starts]] == 5
        more.append(_per(owner, n, upper & (_CLASS[raw[np.minimum(starts + 1, ends - 1)]] == 5)) / words)
    else:
        more += [np.zeros(n)] * 13
    # lines
    line = np.zeros(len(raw), bool)
    line[offsets[:-1][size > 0]] = True
    line[1:] |= raw[:-1] == 0x0A
    at = np.flatnonzero(line)
    of = doc[at]
    lines = np.maximum(_per(of, n), 1)
    after = np.append(at[1:], len(raw))
    after -= raw[after - 1] == 0x0A
    distinct, most = _distinct(hash_spans(raw, at, after, False)[0], of, n)
    more += [np.log1p(lines), distinct / lines, most / lines]
    table[:, N_CLASSES:] = np.stack(more, 1)
    table[size == 0] = 0
    return table


class Trees:
    """Flattened boosted trees: for each, features and thresholds of its inner nodes in heap order, and values of its leaves."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.threshold, self.leaf = base, feature, threshold, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if len(self.feature) and len(x):
            trees = np.arange(len(self.feature))[None, :]
            depth = int(self.leaf.shape[1]).bit_length() - 1
            for first in range(0, len(x), 4096):
                part = x[first : first + 4096]
                rows, node = np.arange(len(part))[:, None], np.zeros((len(part), len(self.feature)), np.int64)
                for _ in range(depth):
                    node = 2 * node + 1 + (part[rows, self.feature[trees, node]] > self.threshold[trees, node])
                total[first : first + 4096] += self.leaf[trees, node - self.feature.shape[1]].sum(1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, penalty: float = 2.0, least: float = 5.0) -> Trees:
    """Histogram gradient boosting with logistic loss."""
    inner = (1 << depth) - 1
    empty = np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1))
    if not len(y):
        return Trees(0.0, *empty)
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return Trees(base, *empty)
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    total = np.full(n, base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            nodes = 1 << level
            local = node - (nodes - 1)
            best = np.full(nodes, 1e-6)
            split = np.zeros(nodes, np.int64)
            where = np.full(nodes, -1)
            for f in range(width):
                key = local * bins + binned[:, f]
                gs = np.cumsum(np.bincount(key, g, nodes * bins).reshape(nodes, bins), 1)
                hs = np.cumsum(np.bincount(key, h, nodes * bins).reshape(nodes, bins), 1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + penalty) + (gt - gs) ** 2 / (ht - hs + penalty) - gt**2 / (ht + penalty)
                gain[(hs < least / 4) | (ht - hs < least / 4)] = 0
                gain[:, len(cuts[f]) :] = 0
                at = gain.argmax(1)
                value = gain[np.arange(nodes), at]
                better = value > best
                best[better], split[better], where[better] = value[better], f, at[better]
            for k in range(nodes):
                if where[k] >= 0:
                    feature[nodes - 1 + k], threshold[nodes - 1 + k] = split[k], cuts[split[k]][where[k]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        local = node - inner
        leaf = -rate * np.bincount(local, g, inner + 1) / (np.bincount(local, h, inner + 1) + penalty)
        total += leaf[local]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(base, np.stack(features), np.stack(thresholds), np.stack(leaves))


def fit(docs: DataFrame, labels: DataFrame) -> Trees:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    got = sample(docs, labels, "quality").select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, x array<double>").toArrow().sort_by("doc_id")
    x = np.array(got["x"].to_pylist(), np.float64).reshape(-1, FEATURES)
    return train(x, got["label"].to_numpy().astype(np.float64))


def score(docs: DataFrame, model: Trees, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = model.score(statistics(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
