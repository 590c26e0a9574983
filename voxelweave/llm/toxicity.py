"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, learned from document labels.

A sentence's score is logistic in its words and their beginnings (so inflected forms share
what was learned). A document is toxic unless none of its sentences is:
P = 1 - prod(1 - p_s). The gradient of the document's log loss goes through the
noisy-or to the sentences, so those that explain a label get the weight, and they can be
pointed out afterwards. Features are picked by their document counts in a bounded sample
(labelled.SAMPLE_ROWS) and trained on the driver, which gets the picked features of the sample's sentences, so memory
there follows the length of the sampled texts; scoring reads every whole text.

Defined cases: null text is the empty text, which has no sentence and score 0; without
toxic labelled rows every score is near 0; sentences end after . ! ? or at a line feed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .labelled import held_out, sample
from .scratch import Scratch, named
from .text import U, buffers, hash_spans, mix, slices

BITS, PREFIXES, KEPT = 20, (4, 5, 6, 7, 8, 9), 4096
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True


def sentences(raw: np.ndarray, offsets: np.ndarray):
    """(start of each sentence, its document, feature ids, sentence of each feature) of concatenated texts."""
    n = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    letter = _LETTER[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(letter & (np.concatenate(([True], ~letter[:-1])) | edge[:-1]))
    ends = np.flatnonzero(letter & (np.concatenate((~letter[1:], [True])) | edge[1:])) + 1
    # a sentence starts with a document or after a stop, and has a word
    begin = edge[:-1].copy()
    begin[1:] |= _STOP[raw[:-1]]
    part = np.cumsum(begin)[starts] if len(starts) else np.zeros(0, np.int64)
    first = np.concatenate(([True], part[1:] != part[:-1])) if len(part) else np.zeros(0, bool)
    of_word = np.cumsum(first) - 1
    at = np.flatnonzero(begin)[part[first] - 1] if len(part) else np.zeros(0, np.int64)
    doc = np.searchsorted(offsets, at, "right") - 1
    ids, of = [], []
    for k, length in enumerate((None, *PREFIXES)):
        long = np.ones(len(starts), bool) if length is None else ends - starts >= length
        a = starts[long]
        b = ends[long] if length is None else a + length
        ids.append((mix(hash_spans(raw, a, b, True)[0] ^ U(k * 0x9E3779B97F4A7C15 % 2**64)) >> U(64 - BITS)).astype(np.int64))
        of.append(of_word[long])
    return at, doc, np.concatenate(ids), np.concatenate(of)


class Model:
    """weights by feature id (mostly 0) and the bias of a sentence."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, bias: float):
        self.ids, self.values, self.bias = ids, weights, bias

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.ids] = self.values
        return out


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def train(label: np.ndarray, doc: np.ndarray, rows: np.ndarray, columns: np.ndarray, width: int, plain: np.ndarray, steps: int = 400, rate: float = 0.1, penalty: float = 2e-5, keep: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights, none of them negative, so that clean words can't hide others, and bias.

    Sentence i is of document doc[i] and has features columns[rows == i]; plain: sentences without any, by document.
    Each step sees a random half of the sentences with features, so that one sentence needn't explain a document alone
    and each learns its share; the last steps fit the bias on all sentences.
    """
    weights, bias, random = np.zeros(width), -5.0, np.random.Generator(np.random.PCG64(7))
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + steps // 2 + 1):
        last = t > steps
        seen = np.ones(len(doc), bool) if last else random.random(len(doc)) < keep
        z = bias + np.where(seen, np.bincount(rows, weights[columns], len(doc)), 0)
        p = 1 / (1 + np.exp(-z))
        p0 = 1 / (1 + np.exp(-bias))
        clean = np.bincount(doc, _softplus(z), len(label)) + plain * _softplus(bias)  # -log(1 - P)
        toxic = -np.expm1(-clean)
        pull = np.where(label > 0, -np.exp(-clean) / np.maximum(toxic, 1e-9), 1.0)
        dz = pull[doc] * p
        g = np.append(np.bincount(columns, (dz * seen)[rows], width) / len(label) + penalty * weights, (dz.sum() + (pull * plain).sum() * p0) / len(label))
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        step = rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        bias -= step[-1]
        if not last:
            weights = np.maximum(weights - step[:-1], 0)
    return weights, float(bias)


def instances_of(docs: DataFrame, labels: DataFrame):
    """The picked features, the sample's labels, and its sentences as `train` takes them (None without toxic rows)."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(sample(docs, labels, "toxic").select("doc_id", "text", "label"), "toxic_sample")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = buffers(b.column(1))
            label = b.column(2).to_numpy()
            for first, last in slices(offsets):
                _, doc, ids, of = sentences(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                keys = np.unique((doc[of] << BITS) | ids)
                yield pa.RecordBatch.from_arrays([pa.array((keys & ((1 << BITS) - 1)).astype(np.int32)), pa.array((label[first:last][keys >> BITS] > 0).astype(np.int32))], ["id", "toxic"])

    sizes = rows.agg(F.count("*").alias("n"), F.coalesce(F.count_if(F.col("label") > 0), F.lit(0)).alias("toxic")).first()
    n, toxic = float(sizes["n"]), float(sizes["toxic"])
    counts = rows.mapInArrow(sets, "id int, toxic int").groupBy("id").agg(F.sum("toxic").alias("t"), F.count("*").alias("c"))
    # toxic documents beyond those that chance explains, in standard deviations, times the log of the ratio of rates
    mean = F.col("c") * F.lit(toxic / max(n, 1))
    ratio = (F.col("t") + 0.5) / F.lit(toxic + 1) / ((F.col("c") - F.col("t") + 0.5) / F.lit(n - toxic + 1))
    ranked = counts.filter("c >= 4").select("id", ((F.col("t") - mean) / F.sqrt(mean + 1) * F.greatest(F.log(ratio), F.lit(0.0))).alias("strength")).filter("strength > 1")
    picked = np.array(sorted(r["id"] for r in ranked.orderBy(F.desc("strength"), "id").limit(KEPT).collect()), np.int64)

    def instances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1, np.int32)
        place[picked] = np.arange(len(picked))
        for b in batches:
            raw, offsets = buffers(b.column(1))
            out = []
            for first, last in slices(offsets):
                at, doc, ids, of = sentences(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                hit = place[ids] >= 0
                order = np.argsort(of[hit], kind="stable")
                of, ids = of[hit][order], place[ids[hit]][order]
                bounds = np.searchsorted(doc[of], np.arange(last - first + 1))
                every = np.bincount(doc, minlength=last - first)
                for i in range(last - first):
                    s = of[bounds[i] : bounds[i + 1]]
                    local = np.unique(s, return_inverse=True)[1].astype(np.int32) if len(s) else np.zeros(0, np.int32)
                    out.append((int(every[i]), local.tobytes(), ids[bounds[i] : bounds[i + 1]].tobytes()))
            n, s, c = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(s, pa.binary()), pa.array(c, pa.binary())], ["doc_id", "label", "n", "s", "c"])

    got = rows.mapInArrow(instances, "doc_id long, label int, n long, s binary, c binary").toArrow().sort_by("doc_id")
    label = np.array(got["label"].to_pylist(), np.int64)
    doc, of, columns, plain, used = [], [], [], [], 0
    for i, (n, s, c) in enumerate(zip(got["n"].to_pylist(), got["s"].to_pylist(), got["c"].to_pylist())):
        s, c = np.frombuffer(s, np.int32), np.frombuffer(c, np.int32)
        k = int(s.max()) + 1 if len(s) else 0
        doc.append(np.full(k, i))
        of.append(s.astype(np.int64) + used)
        columns.append(c)
        plain.append(n - k)
        used += k
    scratch.drop("")
    if not toxic:
        return picked, label, None
    return picked, label, (np.concatenate(doc), np.concatenate(of), np.concatenate(columns), np.array(plain, np.float64))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    picked, label, bags = instances_of(docs, labels)
    if bags is None:
        return Model(np.zeros(0, np.int64), np.zeros(0), -20.0)
    doc, rows, columns, plain = bags
    weights, bias = train(label, doc, rows, columns, len(picked), plain)
    return Model(picked, weights, bias)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, keep: list[str] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted, offending (byte spans and scores of the sentences at or over the threshold) and the columns of keep as kept_0, kept_1 and so on."""
    from pyspark.sql.types import StructField, StructType

    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"), *[named(c).alias(f"kept_{i}") for i, c in enumerate(keep)])
    out = spark.createDataFrame([], "doc_id long, held_out boolean, score double, predicted int, offending array<struct<start:int,end:int,score:double>>").schema
    schema = StructType([*out, *[StructField(f.name, f.dataType) for f in base.schema if f.name.startswith("kept_")]])
    model_ids, values, bias = model.ids, model.values, model.bias
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Model(model_ids, values, bias).table()
        for b in batches:
            raw, offsets = buffers(b.column(2))
            scores, found = [], []
            for first, last in slices(offsets):
                local = offsets[first : last + 1] - offsets[first]
                at, doc, ids, of = sentences(raw[offsets[first] : offsets[last]], local)
                z = bias + np.bincount(of, table[ids], len(at))
                scores.append(-np.expm1(-np.bincount(doc, _softplus(z), last - first)))
                p = 1 / (1 + np.exp(-z))
                spans: list[list] = [[] for _ in range(last - first)]
                ends = np.append(at[1:], local[-1])
                for i in np.flatnonzero(p >= threshold).tolist():
                    d = int(doc[i])
                    spans[d].append({"start": int(at[i] - local[d]), "end": int(min(ends[i], local[d + 1]) - local[d]), "score": float(p[i])})
                found += spans
            p = np.concatenate(scores) if scores else np.zeros(0)
            columns = [b.column(0), b.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(found, span), *[b.column(i) for i in range(3, b.num_columns)]]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    return base.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't toxic, with all their columns."""
    kept = score(docs, fit(docs, labels), keep=docs.columns).filter("predicted = 0")
    return kept.select(*[F.col(f"kept_{i}").alias(c) for i, c in enumerate(docs.columns)])
