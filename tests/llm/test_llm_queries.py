import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from oracle import agree, connect
from voxelweave.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_agrees_with_sql(spark, data, con, name):
    agree(Q.QUERIES[name](spark, data), con, Q.ORACLES[name])


def test_ten_queries():
    assert [q.split("_")[0] for q in Q.QUERIES] == [f"op{n}" for n in range(1, 11)]


def test_media_round_trip(spark, data, docs):
    got = {r["doc_id"]: r for r in Q.op1_media(spark, data).collect()}
    assert len(got) == len(docs)
    same = defaultdict(set)
    for d, text in docs:
        raw = text.encode()
        want = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        same[text].add((r["feature"], r["media_sha256"]))
    assert all(len(v) == 1 for v in same.values()) and len({r["feature"] for r in got.values()}) > len(docs) / 2


def test_fingerprints_of_neighbours(spark, data, docs):
    got = {r["doc_id"]: r for r in Q.op2_syncmers(spark, data).collect()}
    order = sorted(docs, reverse=True)
    near = []
    for i, (d, text) in enumerate(order):
        k = len(text) // 3
        changed = text[: len(text) - k] + order[(i + 1) % len(order)][1][:k]
        assert got[d]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest() and got[d]["n_chars"] == len(text)
        assert 0 <= got[d]["near_next"] <= 1 and 0 <= got[d]["near_edited"] <= 1
        near.append((got[d]["near_edited"], got[d]["near_next"]))
    edited, following = np.array(near).T
    assert 0.4 < edited.mean() < 0.8 and following.mean() < 0.1


def test_language_model(spark, data, docs):
    got = {r["doc_id"]: r for r in Q.op9_trie_lm(spark, data).collect()}
    tokens = {d: [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)), "\n"] for d, t in docs}
    count = Counter(w for d, t in tokens.items() if zlib.crc32(str(d).encode()) % 5 != 1 for w in t)
    n, v = sum(count.values()), len(count)
    for d, t in tokens.items():
        r = got[d]
        base = sum(np.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(t), sum(count[w] > 0 for w in t), n, zlib.crc32(str(d).encode()) % 5 == 1)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
    assert sum(r["score"] for r in got.values() if r["held_out"]) > sum(r["base_score"] for r in got.values() if r["held_out"])


def test_packing(spark, data, docs):
    tokenizers = pytest.importorskip("tokenizers")
    P = pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    ids = {d: [*e.ids, 0] for (d, _), e in zip(docs, t.encode_batch([x for _, x in docs], add_special_tokens=False))}
    rows = Q.op10_packing(spark, data).collect()
    whole, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and 0 < r["length"] <= 2048
        whole[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, x in ids.items():
        parts = sorted(whole[d])
        assert [p for p, _, _ in parts] == list(range(len(parts))) and sum(n for _, _, n in parts) == len(x) and all(n == 2048 for _, _, n in parts[1:])
        assert len(parts) == -(-len(x) // 2048)
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(bins) <= 1.05 * -(-sum(map(len, ids.values())) // 2048) + 1


def _accuracy(df, labels):
    held = [(r["predicted"], labels[r["doc_id"]], r["score"]) for r in df.collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(0 <= s <= 1 for _, _, s in held)
    return sum(p == y for p, y, _ in held) / len(held)


@pytest.mark.parametrize("name, label, least", [("op6_quality", "quality", 0.9), ("op7_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    labels = dict(connect(sf).execute(f"SELECT doc_id, {label} FROM labels").fetchall())
    assert _accuracy(Q.QUERIES[name](spark, sf), labels) >= least


def test_pipeline(spark, data):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = [n for n, _ in C.STAGES]
    assert names == ["toxicity", "near_dedup", "substring_dedup", "mixing", "packing"]
    assert C.run(spark, data).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert C.substring_dedup(spark, docs, data).schema.names == docs.columns
    kept = C.near_dedup(spark, docs, data)
    assert kept.columns == docs.columns and kept.count() < docs.count()


def test_pipeline_stages_match_brute_force(spark, data, tmp_path):
    """Each stage on the table that the stage before it left."""
    import corpus_pipeline as C
    from voxelweave.llm import mixing, toxicity

    tokenizers = pytest.importorskip("tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    docs = spark.read.parquet(f"{data}/documents.parquet")
    tables = [docs]
    for name, stage in C.STAGES:
        stage(spark, tables[-1], data).write.parquet(f"{tmp_path}/{name}")
        tables.append(spark.read.parquet(f"{tmp_path}/{name}"))
    whole, clean, near, cut, mixed, packed = [t.collect() for t in tables]

    labels = spark.read.parquet(f"{data}/labels.parquet")
    toxic = {r["doc_id"] for r in toxicity.classify(docs, labels).filter("predicted = 1").collect()}
    key = lambda r: (r["doc_id"], r["text"])
    assert sorted(map(key, clean)) == sorted(key(r) for r in whole if r["doc_id"] not in toxic) and toxic

    lower = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")]
    sets = {}
    for r in clean:
        w = lower(r["text"])
        sets[r["doc_id"]] = {tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set()
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root[a] != root[b]:
                x, y = sorted((root[a], root[b]))
                root = {d: x if r == y else r for d, r in root.items()}
    assert sorted(map(key, near)) == sorted(key(r) for r in clean if root[r["doc_id"]] == r["doc_id"])

    words = {r["doc_id"]: WORD.findall(r["text"] or "") for r in near}
    seen = Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    texts = {r["doc_id"]: r["text"] for r in near}
    assert sorted(texts) == sorted(r["doc_id"] for r in cut)
    for r in cut:
        w = words[r["doc_id"]]
        gone = {i + k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(35)}
        assert WORD.findall(r["text"] or "") == [x for i, x in enumerate(w) if i not in gone]
        assert gone or r["text"] == texts[r["doc_id"]]
    assert any("\n" in (r["text"] or "") for r in cut)

    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(tables[3]).collect()}
    given = Counter()
    for r in mixed:
        given[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert given == Counter({d: n for d, n in taken.items() if n})

    want = Counter()
    for e in tokenizer.encode_batch([r["text"] or "" for r in mixed], add_special_tokens=False):
        ids = np.array([*e.ids, 0], "<u4")
        want[len(ids), zlib.crc32(ids.tobytes())] += 1
    assert sum(n * k for (n, _), k in want.items()) == sum(r["length"] for r in packed)
    short = Counter((r["length"], r["ids_crc32"]) for r in packed if r["piece"] == 0 and r["length"] < 2048)
    assert all(short[x] >= k for x, k in want.items() if x[0] < 2048)
    space = defaultdict(int)
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == space[r["sequence_id"]]
        space[r["sequence_id"]] += r["length"]
    assert max(space.values()) <= 2048
