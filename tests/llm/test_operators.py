import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from voxelweave.llm import chat, eliasfano, media, mixing, ngram, packing, quality, repeats, scratch, setsketch, syncmers, text, toxicity


# ---- every operator on odd and on empty tables


def operators(path):
    return {
        "media": media.media_digests, "syncmers": syncmers.fingerprints, "near": setsketch.near_duplicates, "mix": mixing.mix, "copies": mixing.copies,
        "repeats": repeats.digests, "without_repeats": repeats.without_repeats, "lm": ngram.score_texts, "pack": lambda d: packing.pack_documents(d, path),
        "without_near": setsketch.without_near_duplicates,
    }


NAMES = ["media", "syncmers", "near", "mix", "copies", "repeats", "without_repeats", "lm", "pack", "without_near"]


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", NAMES)
def test_odd_table(odd, tokenizer, name):
    got = operators(tokenizer)[name](odd)
    n = got.count()
    if name in ("media", "syncmers", "near", "mix", "repeats", "without_repeats", "lm"):
        assert n == odd.count()
    else:
        assert n > 0


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(empty, tokenizer, name):
    assert operators(tokenizer)[name](empty).count() == 0


@pytest.mark.parametrize("kind", [quality, toxicity])
def test_classifiers_on_odd_tables(spark, odd, empty, kind):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert kind.classify(empty, none).count() == 0
    got = kind.classify(odd, none).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    some = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 13)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    assert all(0 <= r["score"] <= 1 for r in kind.classify(odd, some).collect())
    assert toxicity.reject_toxic(odd, some).columns == odd.columns


def test_near_duplicates_of_odd_rows(odd):
    got = {r["doc_id"]: r for r in setsketch.near_duplicates(odd, width=2).collect()}
    assert got[2]["component_id"] == got[3]["component_id"] == got[1]["component_id"] == 1 and not got[2]["kept"]
    assert got[4]["n_shingles"] == got[8]["n_shingles"] == 0 and got[4]["kept"] and got[6]["n_shingles"] == 1 and got[11]["n_shingles"] == 2
    assert got[None]["component_id"] is None and got[None]["kept"]


def test_words_are_split_by_the_six_spaces():
    column = pa.array([None, "", " a\tb\x0bc\x0cd\re\n", "x\x1cy", "é z"])
    h, _, counts = text.word_hashes(column, True)
    assert counts.tolist() == [0, 0, 5, 1, 1]
    again, _, _ = text.word_hashes(pa.array(["A", "a", "b"]), True)
    assert again[0] == again[1] == h[0] and again[2] == h[1]
    assert text.word_hashes(pa.array(["A", "a"]), False)[0].tolist()[0] != again[0]


PATTERNED = [2**10, 2**11, 2**12, 2**13]


def thue_morse(n, first="a", second="b"):
    """A word of n letters, and its complement; sums of powers of any odd base modulo 2**64 are equal for both from some length on."""
    word = "".join((first, second)[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans(first + second, second + first))


def test_patterned_words_have_hashes_of_their_own():
    words = [w for n in PATTERNED for w in thue_morse(n)]
    for lower in (False, True):
        one, two, _ = text.word_hashes(pa.array(words), lower, two=True)
        assert len(set(one.tolist())) == len(set(two.tolist())) == len(words)
    short = [bytes([33 + i % 90]) * n for n in range(1, 200) for i in range(3)]
    one, two, counts = text.word_hashes(pa.array([w.decode() for w in short]), False, two=True)
    assert counts.tolist() == [1] * len(short) and len(set(one.tolist())) == len(set(two.tolist())) == len(set(short))
    # runs of words as well
    runs = [text.windows(text.word_hashes(pa.array([" ".join(w)]), False)[0], 2048, text.BASE_C)[0] for w in thue_morse(2048)]
    assert runs[0] != runs[1]


def test_patterned_words_stay_apart(spark, tokenizer):
    tokenizers = pytest.importorskip("tokenizers")
    rows, k = [], 0
    for n in PATTERNED:
        for w in thue_morse(n):
            rows.append((k, " ".join([w] * 40)))
            k += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = {r["doc_id"]: r["component_id"] for r in setsketch.near_duplicates(docs, width=2).collect()}
    assert near == {i: i for i in range(k)}
    # windows of the same word repeat inside their own text, and only there
    assert all(r["n_removed"] == 40 for r in repeats.digests(docs).collect())
    assert all(r["n_removed"] == 0 for r in repeats.digests(spark.createDataFrame([(i, t[: len(t) // 40 * 35]) for i, t in rows], "doc_id long, text string")).collect())
    seen = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in t.split())
    for r in ngram.score_texts(docs).collect():
        assert r["n_known"] == 40 * (seen[rows[r["doc_id"]][1].split()[0]] > 0) + 1
    t = tokenizers.Tokenizer.from_file(tokenizer)
    texts = [w for n in PATTERNED for w in thue_morse(n)]
    ids, bounds = packing.Encoder(tokenizer).batch(texts)
    assert all(ids[bounds[i] : bounds[i + 1]].tolist() == e.ids for i, e in enumerate(t.encode_batch(texts, add_special_tokens=False)))


@pytest.mark.parametrize("name", NAMES)
def test_bulk_of_equal_rows(bulk, tokenizer, name):
    got = operators(tokenizer)[name](bulk)
    if name in ("media", "syncmers", "near", "mix", "repeats", "without_repeats", "lm"):
        assert got.count() == 3000
    elif name == "without_near":
        kept = Counter((r["doc_id"], r["text"]) for r in got.collect())
        assert sum(n for (d, _), n in kept.items() if d is None) == 1000 and sum(n for (d, _), n in kept.items() if d == 7) == 1
        # texts of one doc_id that aren't alike each have a row
        assert all(n == 1 for (d, _), n in kept.items() if d is not None) and sum(d is not None for d, _ in kept) == 51
    elif name == "copies":
        words = got.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
        assert words == mixing.mix(bulk).agg(F.sum("taken")).first()[0]
    else:
        assert got.count() == 3000


def test_rows_keep_their_columns(odd):
    for f in (mixing.copies, repeats.without_repeats, setsketch.without_near_duplicates):
        assert f(odd).columns == odd.columns
    got = {(r["doc_id"], r["a.b"], r["it`s"], r["_"], r["_dropped"]) for r in repeats.without_repeats(odd).collect()}
    assert {x[1:] for x in got} == {("z",) * 4}


# ---- media


def plain_png(png):
    """A second reader, byte by byte: (height, width, channels, rows of samples)."""
    at, body = 8, b""
    while at < len(png):
        n, kind = int.from_bytes(png[at : at + 4], "big"), png[at + 4 : at + 8]
        data = png[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + data) == int.from_bytes(png[at + 8 + n : at + 12 + n], "big")
        if kind == b"IHDR":
            width, height, channels = int.from_bytes(data[:4], "big"), int.from_bytes(data[4:8], "big"), {0: 1, 2: 3, 4: 2, 6: 4}[data[9]]
        body += data if kind == b"IDAT" else b""
        at += 12 + n
    raw, size, above, out = zlib.decompress(body), width * channels, [0] * width * channels, []
    for y in range(height):
        kind, line = raw[y * (size + 1)], list(raw[y * (size + 1) + 1 : (y + 1) * (size + 1)])
        for x in range(size):
            a, b, c = (line[x - channels] if x >= channels else 0), above[x], (above[x - channels] if x >= channels else 0)
            best = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            line[x] = (line[x] + [0, a, b, (a + b) // 2, best][kind]) % 256
        out.append(line)
        above = line
    return height, width, channels, out


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 7), st.integers(1, 7), st.sampled_from([1, 2, 3, 4]), st.integers(0, 2**31))
def test_png_by_a_plain_reader(h, w, c, seed):
    x = np.random.default_rng(seed).integers(0, 256, (h, w, c), dtype=np.uint8)
    assert plain_png(media.encode(x, (0, 1, 2, 3, 4))) == (h, w, c, x.reshape(h, w * c).tolist())


def test_features_of_texts_by_plain_loops(spark):
    docs = [(i, "".join(random.Random(i).choices("abc déf\n", k=k))) for i, k in enumerate([0, 5, 64, 300, 5000])]
    got = {r["doc_id"]: r for r in media.media_digests(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        raw = t.encode()
        raw += bytes(-len(raw) % 64 if raw else 64)
        png = media.encode(np.frombuffer(raw, np.uint8).reshape(-1, 64))
        height, width, _, rows = plain_png(png)
        assert b"".join(bytes(r) for r in rows) == raw and got[i]["media_sha256"] == hashlib.sha256(png).hexdigest() and got[i]["media_bytes"] == len(png)

        def mean(values, k):  # of the k-th of 32 equal spans, which may cut values
            a, b = k * len(values) / 32, (k + 1) * len(values) / 32
            return sum(v * max(0.0, min(b, j + 1) - max(a, j)) for j, v in enumerate(values)) / (b - a)

        tall = [[mean([row[x] for row in rows], k) for x in range(width)] for k in range(32)]
        small = [[mean(line, k) for k in range(32)] for line in tall]
        wave = lambda u, x: np.cos(np.pi * u * (2 * x + 1) / 64)
        low = [sum(small[y][x] * wave(u, y) * wave(v, x) for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
        middle = sorted(low[1:])[31]
        want = sum(1 << 63 - k for k, v in enumerate(low) if k and v > middle + 1e-5)
        close = sum(1 << 63 - k for k, v in enumerate(low) if k and abs(v - middle) <= 1e-5)  # rounding decides these
        assert int(got[i]["feature"], 16) & ~close == want & ~close


@pytest.mark.parametrize("change", ["short header", "no width", "no height", "huge", "bomb", "more", "cut"])
def test_damaged_images_have_no_hash(spark, change):
    header, data = struct.pack(">IIBBBBB", 2, 2, 8, 0, 0, 0, 0), zlib.compress(bytes(6))
    if change == "short header":
        header = header[:12]
    elif change in ("no width", "no height"):
        header, data = struct.pack(">IIBBBBB", 2 * (change != "no width"), 2 * (change != "no height"), 8, 0, 0, 0, 0), zlib.compress(b"")
    elif change == "huge":
        header = struct.pack(">IIBBBBB", 2**31 - 1, 2**31 - 1, 8, 6, 0, 0, 0)
    elif change == "bomb":
        data = zlib.compress(bytes(1 << 26))
    elif change == "more":
        data = zlib.compress(bytes(7))
    else:
        data = data[:-3]
    bad = media.SIGNATURE + media._chunk(b"IHDR", header) + media._chunk(b"IDAT", data) + media._chunk(b"IEND", b"")
    with pytest.raises(ValueError):
        media.decode(bad)
    assert media.hash_images(spark.createDataFrame([(bad,)], "image binary")).first()["image_hash"] is None


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.sampled_from([1, 2, 3, 4]), st.integers(0, 4), st.integers(0, 2**31))
def test_png_round_trip(h, w, c, kind, seed):
    x = np.random.default_rng(seed).integers(0, 256, (h, w, c), dtype=np.uint8)
    assert (media.decode(media.encode(x, (kind,))) == x).all()
    assert (media.decode(media.encode(x, (0, 1, 2, 3, 4))) == x).all()


def test_png_checksums():
    png = bytearray(media.encode(np.arange(64, dtype=np.uint8).reshape(8, 8)))
    png[40] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        media.decode(bytes(png))
    with pytest.raises(ValueError):
        media.decode(bytes(media.encode(np.zeros((2, 2), np.uint8)))[:-6])
    with pytest.raises(ValueError):
        media.decode(b"GIF")
    header = struct.pack(">IIBBBBB", 1, 1, 16, 0, 0, 0, 0)
    bad = media.SIGNATURE + media._chunk(b"IHDR", header) + media._chunk(b"IDAT", zlib.compress(b"\0\0\0")) + media._chunk(b"IEND", b"")
    with pytest.raises(ValueError):
        media.decode(bad)


def test_cosine_hash_is_robust(spark):
    x = np.kron(np.random.default_rng(3).integers(40, 215, (8, 8)), np.ones((12, 10)))
    noisy = np.clip(x + np.random.default_rng(1).normal(0, 4, x.shape), 0, 255)
    other = np.random.default_rng(2).integers(0, 256, x.shape)
    bits = lambda a: np.unpackbits(np.frombuffer(media.cosine_hash(a.astype(np.uint8)), np.uint8))
    assert (bits(x) != bits(noisy)).sum() <= 6 < (bits(x) != bits(other)).sum()
    rows = [(media.encode(x.astype(np.uint8)),), (None,), (b"broken",)]
    got = [r["image_hash"] for r in media.hash_images(spark.createDataFrame(rows, "image binary")).collect()]
    assert bytes(got[0]) == media.cosine_hash(x.astype(np.uint8)) and got[1:] == [None, None]


# ---- syncmers


def test_syncmers_by_definition():
    raw, k, inner = random.Random(1).randbytes(600), syncmers.K, syncmers.S
    h = text.mix(np.array([int.from_bytes(raw[i : i + inner], "little") for i in range(600 - inner + 1)], np.uint64))
    want = [i for i in range(600 - k + 1) if min(h[i : i + k - inner + 1]) in (h[i], h[i + k - inner])]
    got, at = syncmers.syncmers(raw)
    assert at.tolist() == want
    # a passage has the same anchors wherever it stands
    moved, _ = syncmers.syncmers(b"some words before " + raw)
    assert set(got.tolist()) <= set(moved.tolist())


def test_short_and_long_gaps_have_anchors():
    for raw in (b"", b"x", b"y" * (syncmers.K - 1), *(random.Random(s).randbytes(syncmers.K) for s in range(60))):
        fp = syncmers.anchors(raw)
        assert len(fp) == (1 if raw else 0)
    fp = np.array([[7, 3], [1, 258], [9, 100_000], [2, 100_001]], np.uint32)
    assert (syncmers.from_text(syncmers.to_text(fp)) == fp).all() and len(syncmers.from_text(syncmers.to_text(fp[:0]))) == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=14, unique=True), st.lists(st.integers(0, 12), max_size=14, unique=True))
def test_likeness_by_brute_force(a, b):
    """The longest common subsequence of the anchors over the size of their union."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    want = table[-1][-1] / len({*a, *b}) if a and b else float(len(a) == len(b))
    fp = lambda v: np.stack((np.array(v, np.uint32), np.arange(len(v), dtype=np.uint32) * 5), 1) if v else np.zeros((0, 2), np.uint32)
    assert syncmers.likeness(fp(a), fp(b)) == pytest.approx(want)


def test_likeness():
    a, b = (" ".join(random.Random(s).choices("alpha beta gamma delta epsilon zeta eta theta".split(), k=400)).encode() for s in (1, 2))
    fa, fb = syncmers.anchors(a), syncmers.anchors(b)
    assert syncmers.likeness(fa, fa) == 1 and syncmers.likeness(fa, fb) < 0.6 and syncmers.likeness(fa, syncmers.anchors(b"")) == 0 and syncmers.likeness(syncmers.anchors(b""), syncmers.anchors(b"")) == 1
    assert (syncmers.from_text(syncmers.to_text(fa)) == fa).all() and len(syncmers.anchors(b"short")) == 1


# ---- SetSketch


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(1)
    pool = r.integers(0, 2**63, 900, dtype=np.uint64)
    a, b, union = (np.sort(x) for x in (pool[:600], pool[300:], pool))
    s = setsketch.sketches([a, b, union, np.zeros(0, np.uint64)])
    assert (setsketch.merge(s[0], s[1]) == s[2]).all() and not s[3].any()
    got = setsketch.joint_estimate(s[:1], s[1:2], 600, 600)[0]
    assert abs(got - 1 / 3) < 0.15


def test_bands_lose_few_pairs_at_the_limit():
    assert setsketch.REGISTERS % setsketch.ROWS == 0
    assert (1 - setsketch.LIMIT**setsketch.ROWS) ** (setsketch.REGISTERS // setsketch.ROWS) < 5e-8


def test_components_of_near_copies_match_brute_force(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for family in range(6):
        base = [r.choice(words) for _ in range(r.choice([3, 12, 60, 120]))]
        for _ in range(25):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 9))):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(" ".join(copy))
    sets = [set(zip(t.split(), t.split()[1:])) for t in texts]
    root = list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {x["doc_id"]: x["component_id"] for x in setsketch.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), width=2).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_chain_of_links(spark):
    from voxelweave.llm.graph import components

    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (7, 7)], "a long, b long")
    got = {r["id"]: r["root"] for r in components(links, scratch.Scratch(spark), "t").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100}


# ---- mixing


def test_targets_fill_up_to_the_cap(spark):
    sized = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 5), ("d", 0)], "source string, size long")
    got = {r["source"]: r for r in mixing.targets(sized).collect()}
    assert abs(sum(r["target"] for r in got.values()) - 1.5 * 1115) < 1e-6
    assert all(r["target"] <= 2 * r["source_size"] + 1e-9 for r in got.values()) and got["a"]["target"] == 20 and got[None]["rank"] == 4
    free = [r for r in got.values() if r["target"] < 2 * r["source_size"] - 1e-9]
    assert len({round(r["target"] / r["weight"], 6) for r in free}) <= 1


def test_mix_takes_targets_and_orders_by_schedule(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), "abc"[i % 3]) for i in range(600)], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    for s in "abc":
        mine = [r for r in rows if r["source"] == s]
        assert sum(r["taken"] for r in mine) == int(mine[0]["target"]) and all(0 <= r["taken"] <= 2 * r["size"] and 0 <= r["position"] <= 1 for r in mine)
    early = lambda s: sum(r["taken"] for r in rows if r["source"] == s and r["position"] < 0.3) / sum(r["taken"] for r in rows if r["source"] == s)
    assert early("a") > early("b") > early("c")
    made = mixing.copies(docs).agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert made == sum(r["taken"] for r in rows)


def test_copies_follow_the_schedule_in_every_pass(spark):
    # c, d, e reach their cap of 2 passes; the falling and the rising schedule are among them
    sources = "aabbbcccdddeee"
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1) * (40 if sources[i % 14] == "a" else 1), sources[i % 14]) for i in range(420)], "doc_id long, text string, source string")
    rows = mixing.placed_copies(docs).collect()
    steps = np.linspace(0, 1, 20_001)
    twice = set()
    for r in rows:
        knots = mixing.SCHEDULES[r["rank"] % 3]
        height = np.interp(steps, np.linspace(0, 1, len(knots)), knots)
        demand = np.concatenate(([0.0], np.cumsum((height[1:] + height[:-1]) / 2)))
        want = np.interp((r["before"] + r["copy"] * r["source_size"]) / r["target"], demand / demand[-1], steps)
        assert 0 <= r["position"] <= 1 and abs(r["position"] - want) < 1e-3, r
        if r["copy"]:
            twice.add(r["rank"] % 3)
    assert twice >= {0, 2}
    assert max(r["position"] for r in rows if r["copy"] == 0 and r["source"] == "d") <= min(r["position"] for r in rows if r["copy"] == 1 and r["source"] == "d")
    # the mix hands its rows out in that order
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["position"], r["doc_id"], r["copy"]))]
    assert [x["doc_id"] for x in mixing.copies(docs).collect()] == order


# ---- repeats


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 2**31))
def test_repeats_match_brute_force(spark, seed):
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(12)]
    texts = []
    for _ in range(12):
        w = [r.choice("abcdefgh") for _ in range(r.randint(0, 40))]
        at = r.randint(0, len(w))
        texts.append(" ".join(w[:at] + (passage[r.randint(0, 3) :] if r.random() < 0.5 else []) + w[at:]))
    width = 6
    seen = {}
    for t in texts:
        w = t.split()
        for i in range(len(w) - width + 1):
            seen[tuple(w[i : i + width])] = seen.get(tuple(w[i : i + width]), 0) + 1
    want = {}
    for d, t in enumerate(texts):
        w = t.split()
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone |= set(range(i, i + width))
        want[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for bits in (None, 4):  # a sketch of 16 cells overestimates all: nothing may be lost or added
        got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["text"]) for x in repeats.remove_repeats(docs, width, sketch_bits=bits).collect()}
        assert got == want


def test_clean_texts_stay_as_they_are(spark):
    p = " ".join(f"p{i}" for i in range(40))
    clean = ["", None, " \t two\n\nlines  and\ta tab \n", "é\r\n\x0b日本 😀"]
    cuts = {
        f"one\n\ntwo {p}\nthree  four\n": "one\n\ntwo\nthree  four\n", f"\tfive\n\n{p} six": "\tfive\n\nsix",
        f"seven\n {p}\n": "seven\n", f" {p}\n\neight": " eight", f"nine {p} ten": "nine ten", p: "",
    }
    docs = list(enumerate([*clean, *cuts]))
    got = {x["doc_id"]: x for x in repeats.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[i]["text"] for i, _ in docs] == [*clean, *cuts.values()]
    table = {x["doc_id"]: x["kept_sha256"] for x in repeats.digests(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(table[i] == hashlib.sha256(" ".join((t or "").split()).encode()).hexdigest() for i, t in enumerate([*clean, *cuts.values()]))


def test_gaps():
    for top in (200, 60_000, 2**30):
        x = np.sort(np.random.default_rng(top).integers(0, top, 50))
        assert (repeats.ungaps(repeats.gaps(x)) == x).all()


# ---- trees, bags


def test_trees_learn_and_flatten():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = quality.train(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    # each tree walked node by node
    total = np.full(5, model.base)
    for f, t, leaf in zip(model.feature, model.threshold, model.leaf):
        for i in range(5):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(x[i, f[node]] > t[node])
            total[i] += leaf[node - len(f)]
    assert np.allclose(model.score(x[:5]), 1 / (1 + np.exp(-total)))


def test_toxic_sentence_is_found(spark):
    r = random.Random(1)
    plain = lambda: " ".join(r.choice("tree house green water stone cloud river".split()) for _ in range(8)) + "."
    rows = []
    for i in range(400):
        s = [plain() for _ in range(6)]
        bad = i % 4 == 0
        if bad:
            s[r.randrange(6)] = "you are a " + r.choice(["zorbling", "zorbled", "zorbs"]) + " " + plain()
        rows.append((i, " ".join(s), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.classify(docs.select("doc_id", "text"), docs.select("doc_id", "toxic")).collect()
    assert sum(r["predicted"] == rows[r["doc_id"]][2] for r in got) >= 396
    for r_ in got:
        if r_["predicted"]:
            raw = rows[r_["doc_id"]][1].encode()
            assert any(b"zorb" in raw[s["start"] : s["end"]] for s in r_["offending"])


# ---- chat


def test_chat_escapes_and_parses(spark):
    parts = ["[INST]", "[\\INST]", "</s>", "<\\\\/s>", "<<SYS>>", "<s>", "a", " ", "\n", "[", "<", "\\", "[/INST]", "[ROLE]", "", "é"]
    r = random.Random(5)
    rows = [(c, t, role, "".join(r.choices(parts, k=r.randint(0, 6)))) for c in range(60) for t, role in enumerate(r.choice([["user", "assistant"], ["system", "user", "assistant", "user"], ["assistant"], ["odd<s>role", "user"]]))]
    rows += [(99, None, None, None), (99, 0, "user", "x"), (99, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.segments(df).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), "")).withColumn("turns", chat.parse(F.col("formatted"))).collect()
    for x in got:
        mine = sorted(((t if t is not None else -1, role or "", text_ or "") for c, t, role, text_ in rows if c == x["conv_id"]))
        assert [(t["role"], t["text"]) for t in x["turns"]] == [(role, text_) for _, role, text_ in mine]
        assert [s["loss"] for s in x["segments"]][1::3] == [role == "assistant" for _, role, _ in mine]
        roles = [role for _, role, _ in mine]
        state, ok = "", True
        for role in roles:
            ok &= role in chat.NEXT.get(state, ())
            state = role
        assert x["valid"] == (ok and state in chat.ENDS)
    assert chat.digests(chat.segments(df.limit(0))).count() == 0


# ---- Elias-Fano, language model


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=80, unique=True), st.integers(5001, 2**40))
def test_elias_fano(values, universe):
    v = np.array(sorted(values), np.uint64)
    e = eliasfano.EliasFano.view(eliasfano.EliasFano.build(v, universe))
    q = np.arange(0, 5003, 7, dtype=np.uint64)
    assert e.access(np.arange(len(v))).tolist() == v.tolist() and e.successor(q).tolist() == np.searchsorted(v, q).tolist()
    assert (e.find(v) == np.arange(len(v))).all()
    rare = e.find(q)
    e.index()
    assert e.access(np.arange(len(v))).tolist() == v.tolist() and e.successor(q).tolist() == np.searchsorted(v, q).tolist() and (e.find(q) == rare).all()


def test_trie_finds_what_was_written(tmp_path):
    i = lambda *x: np.array(x, np.int64)
    codes = {"contexts": i(1, 2), "words": i(10, 11, 12), "pairs": i(20, 21), "triples": i(30, 31)}
    with open(tmp_path / "trie", "w+b") as f:
        eliasfano.Trie.write(f, i(3, 8), i(0, 0, 1), i(5, 9, 5), i(0, 1), i(2, 7), i(0, 1), i(1, 2), codes, 5)
    for indexed in (False, True):
        t = eliasfano.Trie.open(tmp_path / "trie")
        if indexed:
            t.index()
        assert t.context(i(3, 8, 4)).tolist() == [0, 1, -1] and t.codes["words"].tolist() == [10, 11, 12]
        w = t.word(i(0, 0, 1, 1, -1), i(5, 9, 5, 9, 5))
        assert w.tolist() == [0, 1, 2, -1, -1]
        p = t.pair(i(0, 1, 1), i(2, 7, 2))
        assert p.tolist() == [0, 1, -1]
        of, context = i(0, 0, 1, 2), i(0, 1, 1)
        assert t.triple(p[of], t.base(p)[of], t.first_word(context)[of], i(0, 1, 2, 2)).tolist() == [-1, 0, 1, -1]


def test_model_is_a_distribution(spark):
    r = random.Random(3)
    words = "a b c d".split()
    docs = [(i, " ".join(r.choices(words, [8, 4, 2, 1], k=r.randint(1, 9)))) for i in range(300)]
    alone = [(1000 + i, w) for i, w in enumerate([*words, ""])]
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    ids = iter(d for d in range(5000, 9000) if held(d))
    probe = [(next(ids), w) for _, w in alone]
    got = {x["doc_id"]: x["score"] for x in ngram.score_texts(spark.createDataFrame(docs + probe, "doc_id long, text string")).collect()}
    # P(w then end) over all first words can't exceed one
    assert sum(10 ** got[d] for d, _ in probe) <= 1.02 and all(got[d] < 0 for d, _ in docs)


@pytest.mark.parametrize("hot, shard", [(ngram.HOT, ngram.SHARD_BYTES), (3, 40)])
def test_model_knows_every_trained_ngram(spark, monkeypatch, tmp_path, hot, shard):
    """Scores against absolute discounting over all pairs and triples, those seen once and twice too; also with contexts in parts over many shards."""
    monkeypatch.setattr(ngram, "HOT", hot)
    monkeypatch.setattr(ngram, "SHARD_BYTES", shard)
    r = random.Random(5)
    docs = [(i, " ".join(r.choices("a b c d e f g".split(), [8, 6, 4, 3, 2, 1, 1], k=r.randint(0, 7)))) for i in range(60)]
    tokens = {d: [*t.split(), "\n"] for d, t in docs}
    one, two, three, after, starts = Counter(), Counter(), Counter(), Counter(), "start"
    for d, t in tokens.items():
        if zlib.crc32(str(d).encode()) % 5 != 1:
            padded = [starts, *t]
            one.update(t)
            after.update(padded[:-1])
            two.update(zip(padded, t))
            three.update(zip(padded, t, t[1:]))
    assert 1 in two.values() and 1 in three.values() and 2 in three.values()
    n, k = sum(one.values()), len(one)

    def discounted(counts, context, word, total, below):
        if not total:
            return below
        follow = [c for g, c in counts.items() if g[:-1] == context]
        return max(counts[(*context, word)] - 0.75, 0) / total + 0.75 * len(follow) / total * below

    folder = str(tmp_path / "model")
    got = {x["doc_id"]: x["score"] for x in ngram.score_texts(spark.createDataFrame(docs, "doc_id long, text string"), folder).collect()}
    tries = [eliasfano.Trie(x["payload"]) for x in spark.read.parquet(folder).collect()]
    assert sum(t.triples.n for t in tries) == len(three) and sum((t.codes["words"] != ngram.NONE).sum() for t in tries) == len(two)
    for d, t in tokens.items():
        padded, want = [starts, *t], 0.0
        for i, w in enumerate(t):
            p = discounted(two, (padded[i],), w, after[padded[i]], (one[w] + 0.5) / (n + 0.5 * (k + 1)))
            want += np.log10(discounted(three, (padded[i - 1], padded[i]), w, two[padded[i - 1], padded[i]], p) if i else p)
        # codes of 8 bits: a factor of up to 10 ** 0.02 each
        assert abs(got[d] - want) <= 0.045 * len(t), (d, t)


def test_pack_unpack():
    a, b = np.arange(5, dtype="<u8") << np.uint64(30), np.zeros(0, "<u4")
    x, y = ngram.unpack(ngram.pack(a, b))
    assert x.tolist() == a.tolist() and len(y) == 0


# ---- packing


def test_pretokens_match_the_library(tokenizer):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokenizer)
    t.encode_special_tokens = True
    r = random.Random(1)
    bits = ["'", "s", "'t", "'re", "'ve", "ll", "d", " ", "  ", "\n", "\t", "É", "1", "²", "!", "\x1c", "<|endoftext|>", "日本", "😀", " ", "\x85", ""]
    texts = ["".join(r.choices(bits, k=r.randint(0, 12))) for _ in range(3000)]
    ids, bounds = packing.Encoder(tokenizer).batch(texts)
    assert all(ids[bounds[i] : bounds[i + 1]].tolist() == e.ids for i, e in enumerate(t.encode_batch(texts, add_special_tokens=False)))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=200), st.integers(1, 20))
def test_best_fit(lengths, open_bins):
    p = packing.BestFit(100, open_bins)
    used = {}
    for n in lengths:
        b, offset = p.add(n)
        assert offset == used.get(b, 0)
        used[b] = offset + n
        assert used[b] <= 100 and p.open <= open_bins
    assert p.made == len(used)


# ---- many alike, few linked


def test_template_documents_in_one_bucket(spark, monkeypatch):
    """1,500 documents that share two thirds of their shingles: many buckets stay open, blocks are small, and components are those of brute force."""
    monkeypatch.setattr(setsketch, "MINOR", (64, 1 << 12))
    monkeypatch.setattr(setsketch, "MAJOR", (96, 1 << 13))
    r = random.Random(8)
    template = [f"t{i}" for i in range(24)]
    texts = [" ".join([*template, *(f"x{r.randrange(40)}" for _ in range(7))]) for _ in range(1500)]
    sets = [frozenset(zip(t.split(), t.split()[1:])) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    ids = {g: k for k, g in enumerate(sorted(set().union(*sets)))}
    table = np.zeros((len(sets), len(ids)), np.float32)
    for i, s in enumerate(sets):
        table[i, [ids[g] for g in s]] = 1
    both, size = table @ table.T, table.sum(1)
    for i, j in zip(*np.nonzero(100 * both >= 80 * (size[:, None] + size[None, :] - both))):
        a, b = find(int(i)), find(int(j))
        root[max(a, b)] = min(a, b)
    assert 20 < len({find(i) for i in range(len(texts))}) < 1500
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {x["doc_id"]: x["component_id"] for x in setsketch.near_duplicates(docs, width=2).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_blocks_bound_every_group(spark, monkeypatch):
    """No group of an open bucket has more rows than two blocks are meant to have, with room for uneven dealing."""
    monkeypatch.setattr(setsketch, "MINOR", (50, 1 << 20))
    monkeypatch.setattr(setsketch, "MAJOR", (80, 1 << 20))
    met = spark.range(1000).select(F.lit(5).cast("long").alias("key"), F.lit(0).alias("band"), F.xxhash64("id").alias("node"), F.lit(10).cast("long").alias("n"), F.col("id"))
    roots = met.filter("id < 400").select(F.col("node").alias("id"), F.lit(1).cast("long").alias("root"))
    rows = setsketch.groups(met.drop("id"), roots)
    sizes = {(r["i"], r["j"]): (r["a"], r["b"]) for r in rows.groupBy("i", "j").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b")).collect()}
    assert len(sizes) == 12 * 13 // 2 + 12 * 5 and max(a + b for a, b in sizes.values()) < 250
    pairs = rows.filter("i < 0 or j < 0").select("node").distinct().count()
    assert pairs == 1000
