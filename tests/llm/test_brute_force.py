"""Operators that SQL can't express, against plain Python versions of their definitions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from oracle import connect
from voxelweave.llm import packing, quality, queries as Q, syncmers, text, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
M = 2**64 - 1
ODD = ["", "a", "A b  c\n\nd, e; f!", "x" * 70 + " " + "x" * 70, "same line\nsame line\nother line", "é日本 😀 don't STOP. 'll [x] #1 | 2", "\n\n \t ", "tail without stop\n" * 3, "a b a b a b a b", "Mixed CASE Words And numbers 123 4567. " * 5]


@pytest.fixture(scope="module")
def docs(data):
    return connect(data).execute("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall()


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ x >> 31


def word_hash(raw, lower, factor=text.BASE_A, half=0):
    if lower:
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    if len(raw) > text.LONG:
        return int.from_bytes(hashlib.blake2b(raw, digest_size=16).digest()[8 * half : 8 * half + 8], "little")
    h = mix(len(raw) * factor + 1 & M)
    for i in range(0, len(raw), 8):
        h = mix(h ^ int.from_bytes(raw[i : i + 8], "little") * factor & M)
    return h


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=90), max_size=6), st.booleans())
def test_word_hashes(texts, lower):
    one, two, counts = text.word_hashes(pa.array(texts, pa.string()), lower, two=True)
    words = [w.encode() for t in texts for w in WORD.findall(t)]
    assert counts.tolist() == [len(WORD.findall(t)) for t in texts]
    assert one.tolist() == [word_hash(w, lower) for w in words] and two.tolist() == [word_hash(w, lower, text.BASE_B, 1) for w in words]


def plain_anchors(raw):
    """(hash, position) of each closed syncmer by its definition; the first of equal hashes counts."""
    k, s = syncmers.K, syncmers.S
    inner = [mix(int.from_bytes(raw[i : i + s], "little")) for i in range(len(raw) - s + 1)]
    out = {}
    for i in range(len(raw) - k + 1):
        window = inner[i : i + k - s + 1]
        if min(window) in (window[0], window[-1]):
            h = inner[i]
            for j in range(s, k, s):
                h = mix(h ^ int.from_bytes(raw[i + j : i + j + s], "little") * text.BASE_A & M)
            out.setdefault(h >> 32, i)
    if not out and raw:
        out[int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little") >> 32] = 0
    return out


def plain_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    x = [b[h] for h, _ in sorted(a.items(), key=lambda v: v[1]) if h in b]
    tails = []
    for p in x:
        i = next((i for i, t in enumerate(tails) if t >= p), len(tails))
        tails[i : i + 1] = [p]
    return len(tails) / len({*a, *b})


def test_fingerprints(spark, data, docs):
    got = {r["doc_id"]: r for r in Q.op2_syncmers(spark, data).collect()}
    order = sorted(docs, reverse=True)
    for i in [*range(0, len(order), 9), len(order) - 1]:
        (d, t), following = order[i], order[(i + 1) % len(order)][1]
        if len(t) > 8000 or len(following) > 8000:
            continue
        n = len(t) // 3
        own, edited, other = (plain_anchors(x.encode()) for x in (t, t[: len(t) - n] + following[:n], following))
        r = got[d]
        assert {int(h): int(p) for h, p in syncmers.from_text(r["fingerprint"])} == own and {int(h): int(p) for h, p in syncmers.from_text(r["edited_fingerprint"])} == edited
        assert r["near_edited"] == pytest.approx(plain_likeness(own, edited)) and r["near_next"] == pytest.approx(plain_likeness(own, other))


def plain_statistics(t):
    raw = t.encode()
    if not raw:
        return [0.0] * quality.FEATURES
    kind = lambda b: next((k + 1 for k, c in enumerate(quality.CLASSES) if b in c), 0)
    share = Counter(map(kind, raw))
    out = [share[k] / len(raw) for k in range(quality.N_CLASSES)]
    words = [raw[m.start() : m.end()] for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    lines = raw.split(b"\n")
    lines = lines[:-1] if raw.endswith(b"\n") else lines
    count = Counter(lines)
    by_line = [math.log1p(len(lines)), len(count) / len(lines), max(count.values()) / len(lines)]
    n = max(1, len(words))
    if not words:
        return out + [math.log1p(len(raw))] + [0.0] * 14 + by_line
    sizes = [len(w) for w in words]
    mean = sum(sizes) / n
    seen, pairs = Counter(words), set(zip(words, words[1:]))
    more = [math.log1p(len(raw)), math.log1p(len(words)), mean, math.sqrt(max(sum(s * s for s in sizes) / n - mean**2, 0))]
    more += [sum(s <= 3 for s in sizes) / n, sum(s > 14 for s in sizes) / n, len(seen) / n, max(seen.values()) / n, len(seen) / math.sqrt(n)]
    more += [sum(a == b for a, b in zip(words, words[1:])) / n, len(pairs) / n]
    more += [sum(kind(w[-1]) == k for w in words) / n for k in (7, 8, 10)]
    more.append(sum(kind(w[0]) == 5 and kind(w[min(1, len(w) - 1)]) == 5 for w in words) / n)
    return out + more + by_line


def test_quality_scores(spark, data, docs):
    # together and each alone: a text's statistics don't depend on what else is in its batch
    assert np.allclose(quality.statistics(pa.array(ODD)), [plain_statistics(t) for t in ODD])
    assert all(np.allclose(quality.statistics(pa.array([t]))[0], plain_statistics(t)) for t in ODD)
    model = quality.fit(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet"))
    got = {r["doc_id"]: r for r in Q.op6_quality(spark, data).collect()}
    for d, t in docs[::4]:
        x, total = plain_statistics(t), model.base
        for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + (x[feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        score = 1 / (1 + math.exp(-total))
        assert got[d]["score"] == pytest.approx(score, abs=1e-6) and got[d]["predicted"] == (got[d]["score"] >= 0.7)
        assert got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2)


def plain_toxicity(t, model):
    weight = dict(zip(model.ids.tolist(), model.values.tolist()))
    clean = 1.0
    for s in re.split(rb"(?<=[.!?\n])", t.encode()):
        words = re.findall(rb"[A-Za-z\x80-\xff]+", s)
        if words:
            z = model.bias
            for w in words:
                for k, size in enumerate((None, *toxicity.PREFIXES)):
                    if size is None or len(w) >= size:
                        z += weight.get(mix(word_hash(w[:size], True) ^ (k * 0x9E3779B97F4A7C15 & M)) >> 64 - toxicity.BITS, 0.0)
            clean *= 1 - 1 / (1 + math.exp(-z))
    return 1 - clean


def test_toxicity_scores(spark, data, docs):
    model = toxicity.fit(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet"))
    got = {r["doc_id"]: r for r in Q.op7_toxicity(spark, data).collect()}
    for d, t in docs[::3]:
        assert got[d]["score"] == pytest.approx(plain_toxicity(t, model), abs=1e-4) and got[d]["predicted"] == (got[d]["score"] >= 0.3)


def test_language_model_scores(spark, data, docs):
    """Absolute discounting over every pair and triple of the training part; 8-bit codes allow a factor of 10 ** 0.02 for each of their shares."""
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    tokens = {d: ["<s>", *WORD.findall(lower(t)), "\n"] for d, t in docs}
    one, two, three = Counter(), Counter(), Counter()
    for d, t in tokens.items():
        if zlib.crc32(str(d).encode()) % 5 != 1:
            one.update(t[1:])
            two.update(zip(t, t[1:]))
            three.update(zip(t, t[1:], t[2:]))
    n, kinds = sum(one.values()), len(one)
    after, after_two, kinds_one, kinds_two = Counter(), Counter(), Counter(v for v, _ in two), Counter((u, v) for u, v, _ in three)
    for (v, _), c in two.items():
        after[v] += c
    for (u, v, _), c in three.items():
        after_two[u, v] += c
    step = lambda c, total, kinds, below: max(c - 0.75, 0) / total + 0.75 * kinds / total * below if total else below
    got = {r["doc_id"]: r["score"] for r in Q.op9_trie_lm(spark, data).collect()}
    for d, t in tokens.items():
        want = 0.0
        for i in range(1, len(t)):
            p = step(two[t[i - 1], t[i]], after[t[i - 1]], kinds_one[t[i - 1]], (one[t[i]] + 0.5) / (n + 0.5 * (kinds + 1)))
            if i > 1:
                u, v = t[i - 2], t[i - 1]
                p = step(three[u, v, t[i]], after_two[u, v], kinds_two[u, v], p)
            want += math.log10(p)
        assert abs(got[d] - want) <= 0.045 * (len(t) - 1)
        # errors of many tokens even out
        assert len(t) < 50 or abs(got[d] - want) <= 0.01 * (len(t) - 1), (d, got[d], want)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=150), st.integers(1, 12))
def test_best_bin_is_taken(lengths, most):
    """Every open bin looked at: the one with least free space that holds the piece; beyond `most` open ones the fullest closes."""
    p, free = packing.BestFit(60, most), []
    for n in lengths:
        fits = sorted(f for f in free if f >= n)
        f = fits[0] if fits else 60
        if fits:
            free.remove(f)
        _, offset = p.add(n)
        assert offset == 60 - f
        if f > n:
            free.append(f - n)
            if len(free) > most:
                free.remove(min(free))
        assert p.open == len(free)


def test_packing_order_is_the_same_in_every_run(spark, data):
    tokenizer = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    table = spark.read.parquet(f"{data}/documents.parquet")
    key = lambda r: (r["doc_id"], r["piece"])
    runs = [sorted((key(r), r["sequence_id"], r["offset"]) for r in packing.pack_documents(t, tokenizer).collect()) for t in (table, table.repartition(7))]
    assert runs[0] == runs[1]


def test_random_texts_of_many_kinds_pack_like_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    library.encode_special_tokens = True
    r = random.Random(3)
    texts = ["".join(chr(r.choice([*range(32, 127), 0xE9, 0x65E5, 0x1F600, 10])) for _ in range(r.randint(0, 60))) for _ in range(400)]
    encoder = packing.Encoder(path)
    for _ in range(2):  # from an empty cache, then from a full one
        ids, bounds = encoder.batch(texts)
        assert all(ids[bounds[i] : bounds[i + 1]].tolist() == e.ids for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)))


def test_next_documents_where_ids_repeat(spark, monkeypatch):
    """An id with half of the rows and rows without one fill buckets of their own; every row still has the next one of the whole order."""
    monkeypatch.setattr(syncmers, "BUCKET_BYTES", 400)
    r = random.Random(2)
    rows = [(5 if i % 2 else None if i % 5 == 0 else i, "".join(r.choices("abc déf", k=r.randint(0, 40)))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tagged = syncmers.with_next(df)
    assert tagged.filter("guard = 0").groupBy("seq").count().agg({"count": "max"}).first()[0] < 120
    ties = {(d, t): h for d, t, h in df.selectExpr("doc_id", "text", "xxhash64(text)").collect()}
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, ties[x]), reverse=True)
    want = Counter()
    for i, (d, t) in enumerate(order):
        k = len(t) // 3
        want[d, hashlib.sha256((t[: len(t) - k] + order[(i + 1) % len(order)][1][:k]).encode()).hexdigest()] += 1
    assert Counter((x["doc_id"], x["edited_sha256"]) for x in syncmers.fingerprints(df).collect()) == want
