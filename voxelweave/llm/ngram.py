"""Scoring texts by a three-word language model held in Elias-Fano tries.

Tokens are words (lower-cased in A-Z) and one end per text. All counts are over the whole
training part of the corpus:

1. Texts become chunks of ranks of the chunk's distinct tokens, written once; no text is shuffled. 2. Chunks send
their distinct tokens and counts; hash buckets add them up, number the tokens and
answer. 3. Chunks send all their word pairs and triples, with their counts in training, to the shard of
their last context word. A shard adds them up, smooths by absolute
discounting, quantises, writes its trie to a file, drops what it was built from, maps the file and answers each chunk's pairs and
triples, those of held-out texts too, by successor search in the mapped levels. No n-gram that occurs in training is left out.
4. Chunks score: with f the discounted share and m the mass left,
P(w | u, v) = f(w | u, v) + m(u, v) P(w | v), P(w | v) = f(w | v) + m(v) P(w),
P(w) = (c + 0.5) / (N + 0.5 (V + 1)).

Chunks and shards grow in number with the input. A context word v that occurs more than `hot` times is split into
parts over several shards, its triples by the word u before, its pairs by the word after; what is left for v is the sum of what is left in the
parts, each of which a chunk that has v asks. `hot` is at least 2**-16 of all tokens, so there are at most 65,536 parts beyond the first ones.

Tokens are told apart by 64-bit hashes; after the first step they have
numbers, which are a few bytes in the messages that follow; a triple's last word is sent as its place among the chunk's words after v.

Defined cases: null text is the empty text, whose one token is the end; a null doc_id counts as the
empty text for the fold; an empty training part leaves P = 0.5 / 0.5 = 1 for each token;
equal rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .chunks import grown, log2_up
from .eliasfano import Trie
from .repeats import _blocks, _frame
from .scratch import Scratch, text_bytes
from .text import BASE_C, U, buffers, mix, slices, word_hashes

FOLDS, HELD_OUT = 5, 1
END, BEGIN = 0x452821E638D01377, 0xBE5466CF34E90C6C
DISCOUNT = 0.75
#: 8-bit codes of log10 values from -RANGE to 0, finer towards 0: squares of equal steps; the last stands for a share of 0.
RANGE, NONE = 10.16, 255
CHUNK_BYTES, SHARD_BYTES, MOST_BYTES = 8 << 20, 4 << 20, 32 << 20
#: A context is split beyond so many occurrences, or a larger share of the tokens, see `hot`.
HOT, HOT_SHARE = 1 << 22, 16

TEXTS_SQL = "chunk long, doc_ids array<long>, held_out array<boolean>, n_train long, sizes binary, words binary, uses binary, end long, hashes binary, counts binary"
MESSAGE = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("chunk", pa.int64()), ("payload", pa.binary()), ("tokens", pa.int64()), ("distinct", pa.int64()), ("numbers", pa.int64())])
MESSAGE_SQL = "kind int, bucket long, chunk long, payload binary, tokens long, distinct long, numbers long"
COUNTS, ANSWERS, TRIE = 0, 1, 2


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def code(share: np.ndarray) -> np.ndarray:
    """A share of 0 to 1 as an 8-bit code of its logarithm."""
    with np.errstate(divide="ignore"):
        return np.where(share > 0, np.clip(np.round(np.sqrt(np.maximum(-np.log10(share), 0) / RANGE) * (NONE - 1)), 0, NONE - 1), NONE).astype(np.uint8)


_SHARES = np.append(10.0 ** (-((np.arange(NONE) / (NONE - 1)) ** 2) * RANGE), 0.0)


def share(codes: np.ndarray) -> np.ndarray:
    return _SHARES[codes]


_ZSTD = pa.Codec("zstd", compression_level=1)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, none negative, in one string: byte plane after byte plane, as many as the greatest needs, in zstd."""
    out = [bytes([len(arrays)])]
    for a in arrays:
        size = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
        out.append(np.array([len(a) << 8 | size], "<u8").tobytes())
        out.append(np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(len(a), 8)[:, :size].T).tobytes())
    raw = b"".join(out)
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def unpack(packed: bytes) -> list[np.ndarray]:
    """The arrays, those of single bytes as uint8, all others as int64."""
    raw = _ZSTD.decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True)
    out, at = [], 1
    for _ in range(raw[0]):
        head = int(np.frombuffer(raw, "<u8", 1, at)[0])
        n, size = head >> 8, head & 255
        planes = np.frombuffer(raw, np.uint8, n * size, at + 8).reshape(size, n)
        if size == 1:
            out.append(planes[0])
        else:
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :size] = planes.T
            out.append(wide.reshape(-1).view("<i8"))
        at += 8 + n * size
    return out


def _ranked(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and the place of each value among them."""
    codes, distinct = pd.factorize(h)
    order = np.argsort(distinct)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], place[codes]


def _order(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The order of rows by (first, second), which aren't negative; rows that are equal in both keep theirs."""
    n = len(first)
    if not n:
        return np.zeros(0, np.int64)
    low, place = int(second.max()).bit_length(), (n - 1).bit_length()
    if int(first.max()).bit_length() + low + place > 63:
        return np.lexsort((second, first))
    # numbers sort several times faster than their places do
    return np.sort((((first << low) | second) << place) | np.arange(n)) & ((1 << place) - 1)


def _distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows (first, second) in order, and the place of each row among them."""
    order = _order(first, second)
    a, b = first[order], second[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    place = np.empty(len(a), np.int64)
    place[order] = np.cumsum(new) - 1
    return a[new], b[new], place


def _by_use(uses: np.ndarray) -> np.ndarray:
    """Ranks of tokens, the most used first."""
    return np.argsort(-uses.astype(np.int64), kind="stable")


def _hashes(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(gaps.astype(np.int64).view(np.uint64), dtype=np.uint64)


def encode(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """Chunks of texts as ranks among the chunk's distinct token hashes: one row a chunk, see TEXTS_SQL."""

    def chunk(at: int, table: pa.Table) -> list:
        h, _, counts = word_hashes(table["text"], lower=True)
        sizes = counts + 1
        every = np.zeros(len(h) + len(counts), np.uint64)
        is_end = np.zeros(len(every), bool)
        is_end[np.cumsum(sizes) - 1] = True
        every[is_end], every[~is_end] = U(END), h
        distinct, word = _ranked(every)
        held = table["held_out"].to_numpy(zero_copy_only=False).astype(bool)
        seen = np.bincount(word[np.repeat(~held, sizes)], minlength=len(distinct))
        uses = np.bincount(word, minlength=len(distinct))
        often = np.empty(len(distinct), np.int64)  # frequent tokens get small numbers, which pack well; their order follows from `uses`
        often[_by_use(uses)] = np.arange(len(distinct))
        return [at, table["doc_id"].to_pylist(), held.tolist(), int((~held).sum()), pack(sizes), pack(often[word]), pack(uses), int(np.searchsorted(distinct, U(END))), pack(np.diff(distinct, prepend=U(0))), pack(seen)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, at = [], 0, TaskContext.get().partitionId() << 32

        def out(last: bool):
            nonlocal waiting, size, at
            table = pa.Table.from_batches(waiting)
            offsets = buffers(table["text"])[1]
            waiting, size = [], 0
            for a, b in slices(offsets, chunk_bytes):
                part = table.slice(a, b - a)
                if b == table.num_rows and not last:
                    waiting, size = part.to_batches(), int(offsets[b] - offsets[a])
                else:
                    row, at = chunk(at, part), at + 1
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names)

        for b in batches:
            if b.num_rows:
                waiting.append(b)
                size += b.column(1).nbytes
                if size >= 2 * chunk_bytes:
                    yield from out(False)
        if waiting:
            yield from out(True)

    names = [x.split()[0] for x in TEXTS_SQL.split(", ")]
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("held_out")]
    return docs.select(*columns).mapInArrow(run, TEXTS_SQL)


class Numbers:
    """Where contexts live: numbers of tokens have `bits` bits, shards are the highest `shard_bits` of a mixed number."""

    def __init__(self, shard_bits: int, rank_bits: int, starts: int, hot: int):
        self.shard_bits, self.rank_bits, self.starts, self.hot = shard_bits, rank_bits, starts, hot
        self.begin = 1 << (shard_bits + rank_bits)
        self.bits = shard_bits + rank_bits + 1

    def parts(self, total: np.ndarray) -> np.ndarray:
        return np.maximum(1, -(-total // self.hot))

    def part(self, v: np.ndarray, part: np.ndarray) -> np.ndarray:
        """The shard of a context's part."""
        return (mix(v.astype(np.uint64) + part.astype(np.uint64) * U(BASE_C)) >> U(64 - self.shard_bits)).astype(np.int64)

    def shard(self, v: np.ndarray, parts: np.ndarray, by: np.ndarray | None = None) -> np.ndarray:
        """The shard of context v's part that holds `by` (None: of its first part)."""
        return self.part(v, np.zeros(len(v), np.uint64) if by is None else mix(by.astype(np.uint64)) % parts.astype(np.uint64))


class Grams:
    """A chunk's distinct pairs and triples, with counts in training, and what of them it sends to each shard.

    Local words are ranks, the start of a text is the last one. A unit is a context in a shard; entries are a unit's words; a preceded context (u, v)
    belongs to the unit of its part. Whatever holds a token that training doesn't have isn't sent.
    """

    def __init__(self, row: dict, counts: np.ndarray, numbers: np.ndarray, space: Numbers):
        self.word = _by_use(unpack(row["uses"])[0])[unpack(row["words"])[0]]
        self.sizes, self.counts = unpack(row["sizes"])[0].astype(np.int64), counts
        word, n, tokens = self.word, len(numbers), len(self.word)
        self._units(np.append(numbers, space.begin), np.append(counts, space.starts), row["end"], space)
        units, known = len(self.unit_v), self.total > 0
        training = np.repeat(~np.asarray(row["held_out"], bool), self.sizes)
        first = np.cumsum(self.sizes) - self.sizes
        self.before = before = np.empty_like(word)
        before[1:] = word[:-1]
        before[first] = n
        later = np.ones(tokens, bool)
        later[first] = False
        self.later = at = np.flatnonzero(later)
        # rows that aren't sent sort behind all others, as one that is dropped
        e_unit, c_unit = self._unit_of(before, word, space), self._unit_of(word, before, space)
        sent, led = (e_unit >= 0) & known[word], (c_unit >= 0) & known[before]
        t_sent = led[at - 1] & known[word[at]]
        # where a context is in parts, its part has the words of its triples too
        away = at[t_sent & (c_unit[at - 1] != e_unit[at])]
        unit, entry, place = _distinct(np.concatenate((np.where(sent, e_unit, units), c_unit[away - 1])), np.concatenate((np.where(sent, word, 0), word[away])))
        self.entry = place[:tokens]
        entries = int(np.searchsorted(unit, units))
        self.e_unit, self.e_number = unit[:entries], self.number[entry[:entries]]
        self.e_count = np.bincount(self.entry[training], minlength=entries)[:entries]
        unit, context, self.context = _distinct(np.where(led, c_unit, units), np.where(led, before, 0))
        contexts = int(np.searchsorted(unit, units))
        self.c_unit, self.c_number = unit[:contexts], self.number[context[:contexts]]
        self.c_count = np.bincount(self.context[training], minlength=contexts)[:contexts]
        t_entry = self.entry.copy()
        t_entry[away] = place[tokens:]
        of, entry, self.triple = _distinct(np.where(t_sent, self.context[at - 1], contexts), np.where(t_sent, t_entry[at], 0))
        triples = int(np.searchsorted(of, contexts))
        self.t_context = of[:triples]
        self.t_rank = entry[:triples] - np.searchsorted(self.e_unit, np.arange(units))[self.c_unit[self.t_context]]
        self.t_count = np.bincount(self.triple[training[at]], minlength=triples)[:triples]

    def _units(self, number: np.ndarray, total: np.ndarray, end: int, space: Numbers) -> None:
        """Contexts by shard, then number: one unit each, or one for each shard that has a part of it."""
        self.number, self.total = number, total
        is_context = total > 0
        is_context[end] = False
        v = np.flatnonzero(is_context)
        self.parts = space.parts(total)
        shard = space.shard(number[v], self.parts[v])
        self.split = is_context & (self.parts > 1)
        hot = np.flatnonzero(self.split)
        if len(hot):
            each = np.repeat(hot, self.parts[hot])
            part = np.arange(len(each)) - np.repeat(np.cumsum(self.parts[hot]) - self.parts[hot], self.parts[hot])
            both = np.unique(space.part(number[each], part) * len(number) + each)
            one = ~self.split[v]
            v, shard = np.concatenate((v[one], both % len(number))), np.concatenate((shard[one], both // len(number)))
        order = _order(shard, number[v])
        self.unit_v, self.unit_shard = v[order], shard[order]
        self.own = np.full(len(number), -1, np.int64)
        self.own[self.unit_v] = np.arange(len(order))
        if len(hot):
            at = np.flatnonzero(self.split[self.unit_v])
            key = self.unit_shard[at] * len(number) + self.unit_v[at]
            order = np.argsort(key)
            self.hot_key, self.hot_unit = key[order], at[order]

    def _unit_of(self, v: np.ndarray, by: np.ndarray, space: Numbers) -> np.ndarray:
        """The unit that holds context v's part of `by`; -1 where v isn't a context."""
        out = self.own[v]
        if self.split.any():
            hot = np.flatnonzero(self.split[v])
            shard = space.shard(self.number[v[hot]], self.parts[v[hot]], self.number[by[hot]])
            out[hot] = self.hot_unit[np.searchsorted(self.hot_key, shard * len(self.number) + v[hot])]
        return out

    def runs(self):
        """(shard, units, entries, preceded contexts, triples): ranges of each for a shard."""
        for s, i, j in _blocks(self.unit_shard, 0):
            entries, contexts = np.searchsorted(self.e_unit, [i, j]), np.searchsorted(self.c_unit, [i, j])
            yield s, (i, j), tuple(entries.tolist()), tuple(contexts.tolist()), tuple(np.searchsorted(self.t_context, contexts).tolist())

    def messages(self):
        number, total = self.number[self.unit_v], self.total[self.unit_v]
        for s, (i, j), (a, z), (c, d), (e, f) in self.runs():
            parts = [np.diff(number[i:j], prepend=0), total[i:j], _per(self.e_unit[a:z] - i, j - i), self.e_number[a:z], self.e_count[a:z]]
            parts += [_per(self.c_unit[c:d] - i, j - i), self.c_number[c:d], self.c_count[c:d]]
            parts += [_per(self.t_context[e:f] - c, d - c), _steps(self.t_rank[e:f], self.t_context[e:f]), self.t_count[e:f]]
            yield s, pack(*parts)

    def probabilities(self, told: dict[int, bytes], one: np.ndarray) -> np.ndarray:
        """P(w | u, v) of each token, from the shards' answers and the probabilities of the words alone."""
        left, f2 = np.zeros(len(self.unit_v)), np.zeros(len(self.e_unit) + 1)
        m3, f3 = np.ones(len(self.c_unit) + 1), np.zeros(len(self.t_context) + 1)
        for s, (i, j), (a, z), (c, d), (e, f) in self.runs():
            left[i:j], f2[a:z], m3[c:d], f3[e:f] = (share(x) for x in unpack(told[s]))
        m2 = np.ones(len(self.number))
        m2[self.unit_v] = np.bincount(self.unit_v, left, len(m2))[self.unit_v]
        two = f2[self.entry] + np.minimum(m2, 1)[self.before] * one[self.word]
        out = two.copy()
        out[self.later] = f3[self.triple] + m3[self.context[self.later - 1]] * two[self.later]
        return out


def _per(owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, minlength=n).astype("<u4")


def _steps(x: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Values that ascend in each run of one owner, as differences that start anew with each run."""
    out = np.diff(x, prepend=0)
    first = np.concatenate(([True], owner[1:] != owner[:-1])) if len(x) else np.zeros(0, bool)
    out[first] = x[first]
    return out.astype("<u8")


def _unsteps(d: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The inverse, from the sizes of the runs."""
    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(d.astype(np.int64))))
    sizes = sizes.astype(np.int64)
    return total[1:] - np.repeat(total[np.cumsum(sizes) - sizes], sizes)


def _keys(message: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(v; words and their unit; words before and their unit; entries and preceded contexts of triples) of a message."""
    units = np.arange(len(message[0]))
    word_unit, pair_unit = np.repeat(units, message[2]), np.repeat(units, message[5])
    first = np.cumsum(message[2], dtype=np.int64) - message[2]
    context = np.repeat(np.arange(len(pair_unit)), message[8])
    entry = _unsteps(message[9], message[8]) + first[pair_unit[context]]
    return np.cumsum(message[0], dtype=np.int64), message[3].astype(np.int64), word_unit, message[6].astype(np.int64), pair_unit, entry, context


def build_shard(file, payloads: list[bytes], bits: int) -> None:
    """Write the trie of all messages' counts to a file."""
    sent = [unpack(x) for x in payloads]
    keys = [_keys(m) for m in sent]
    cat = lambda arrays: np.concatenate([np.asarray(a, np.int64) for a in arrays])
    v, own = _ranked(cat(k[0] for k in keys))
    total = np.zeros(len(v), np.int64)
    total[own] = cat(m[1] for m in sent)
    units = np.cumsum([0, *(len(m[0]) for m in sent)])
    word_owner, word, place_w = _distinct(own[cat(k[2] + a for k, a in zip(keys, units))], cat(k[1] for k in keys))
    word_count = np.bincount(place_w, cat(m[4] for m in sent), len(word)).astype(np.int64)
    pair_owner, pair, place_p = _distinct(own[cat(k[4] + a for k, a in zip(keys, units))], cat(k[3] for k in keys))
    pair_count = np.bincount(place_p, cat(m[7] for m in sent), len(pair)).astype(np.int64)
    entries, contexts = np.cumsum([0, *(len(m[3]) for m in sent)]), np.cumsum([0, *(len(m[6]) for m in sent)])
    triple_owner, triple, place_t = _distinct(place_p[cat(k[6] + a for k, a in zip(keys, contexts))], place_w[cat(k[5] + a for k, a in zip(keys, entries))])
    triple_count = np.bincount(place_t, cat(m[10] for m in sent), len(triple)).astype(np.int64)
    # only what training has
    kept = triple_count > 0
    triple_owner, triple, triple_count = triple_owner[kept], triple[kept], triple_count[kept]
    used = np.bincount(triple_owner, minlength=len(pair)) > 0
    needed = word_count > 0
    distinct = np.bincount(word_owner[needed], minlength=len(v))
    needed[triple] = True
    f2 = np.maximum(word_count - DISCOUNT, 0) / total[word_owner]
    # of a context in parts, this part's share of what is left
    m2 = np.minimum(DISCOUNT * distinct / total, 1)
    f3 = (triple_count - DISCOUNT) / pair_count[triple_owner]
    m3 = np.minimum(DISCOUNT * np.bincount(triple_owner, minlength=len(pair))[used] / pair_count[used], 1)
    codes = {"contexts": code(m2), "words": code(f2[needed]), "pairs": code(m3), "triples": code(f3)}
    Trie.write(file, v, word_owner[needed], word[needed], pair_owner[used], pair[used], (np.cumsum(used) - 1)[triple_owner], (np.cumsum(needed) - 1)[triple], codes, bits)


def ask(trie: Trie, payload: bytes) -> bytes:
    """Answers to a chunk's message: codes of m2 by unit, f2 by word, m3 by (u, v), f3 by triple."""
    v, word, word_unit, before, pair_unit, entry, of = _keys(unpack(payload))
    context = trie.context(v)
    w = trie.word(context[word_unit], word)
    p = trie.pair(context[pair_unit], before)
    t = trie.triple(p[of], trie.base(p)[of], trie.first_word(context)[pair_unit][of], w[entry])
    tell = lambda level, at, none: np.append(trie.codes[level], np.uint8(none))[at]
    return pack(tell("contexts", context, NONE), tell("words", w, NONE), tell("pairs", p, 0), tell("triples", t, NONE))


def _by_bucket(table: pa.Table, kind: int) -> dict[int, bytes]:
    return {b: x.as_py() for k, b, x in zip(table["kind"].to_pylist(), table["bucket"].to_pylist(), table["payload"]) if k == kind}


def score_texts(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    model: a folder for the tries themselves, as Parquet (bucket: the shard; payload: the file that Trie maps).
    """
    spark = docs.sparkSession
    scratch, size = Scratch(spark), max(1, text_bytes(docs))
    chunk_bytes = max(1 << 18, min(grown(size, CHUNK_BYTES, MOST_BYTES), size // (2 * spark.sparkContext.defaultParallelism)))
    shard_bits = max(1, log2_up(size // grown(size, SHARD_BYTES, MOST_BYTES)))
    texts = scratch.save(encode(docs, chunk_bytes), "texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, hashes, counts in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                h, c = _hashes(unpack(hashes.as_py())[0]), unpack(counts.as_py())[0]
                shard = (h >> U(64 - shard_bits)).astype(np.int64)
                yield from _frame([(COUNTS, s, chunk, pack(np.diff(h[i:j], prepend=U(0)), c[i:j]), 0, 0, 0) for s, i, j in _blocks(shard, 0)], MESSAGE).to_batches()

    def add_up(table: pa.Table) -> pa.Table:
        sent = [unpack(x.as_py()) for x in table["payload"]]
        known, place = _ranked(np.concatenate([_hashes(s[0]) for s in sent]))
        total = np.bincount(place, np.concatenate([s[1] for s in sent])).astype(np.int64)
        rank = np.empty(len(total), np.int64)  # numbers go by frequency, so those of most tokens are small
        rank[np.argsort(-total, kind="stable")] = np.arange(len(total))
        at, out, bucket = 0, [], table["bucket"][0].as_py()
        for i, (chunk, s) in enumerate(zip(table["chunk"].to_pylist(), sent)):
            mine = place[at : at + len(s[0])]
            summary = (0, 0, 0) if i else (int(total.sum()), int((total > 0).sum()), len(known))
            out.append((COUNTS, bucket, chunk, pack(total[mine], rank[mine]), *summary))
            at += len(mine)
        return _frame(out, MESSAGE)

    sent = texts.select("chunk", "hashes", "counts").mapInArrow(count, MESSAGE_SQL)
    counted = scratch.save(sent.groupBy("bucket").applyInArrow(add_up, MESSAGE_SQL), "counts")
    whole = counted.agg(F.sum("tokens").alias("tokens"), F.sum("distinct").alias("distinct"), F.max("numbers").alias("numbers")).first()
    every, kinds, rank_bits = int(whole["tokens"] or 0), int(whole["distinct"] or 0), log2_up(int(whole["numbers"] or 1) + 1)
    starts = int(texts.agg(F.sum("n_train")).first()[0] or 0)
    space = Numbers(shard_bits, rank_bits, starts, max(HOT, every >> HOT_SHARE))

    def grams(table: pa.Table, told: pa.Table) -> Grams:
        got, counts, numbers = _by_bucket(told, COUNTS), [], []
        for b in sorted(got):
            total, rank = unpack(got[b])
            counts.append(total.astype(np.int64))
            numbers.append((b << rank_bits) + rank.astype(np.int64))
        row = {n: table[n][0].as_py() for n in ("words", "uses", "sizes", "held_out", "end")}
        return Grams(row, np.concatenate(counts), np.concatenate(numbers), space)

    def send(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _frame([], MESSAGE)
        chunk = table["chunk"][0].as_py()
        return _frame([(ANSWERS, s, chunk, x, 0, 0, 0) for s, x in grams(table, told).messages()], MESSAGE)

    def shard(table: pa.Table) -> pa.Table:
        bucket, payloads, out = table["bucket"][0].as_py(), [x.as_py() for x in table["payload"]], []
        with tempfile.TemporaryFile() as file:
            build_shard(file, payloads, space.bits)
            trie = Trie.map(file)
            trie.index()
            out += [(ANSWERS, bucket, c, ask(trie, x), 0, 0, 0) for c, x in zip(table["chunk"].to_pylist(), payloads)]
            if model:
                file.seek(0)
                out.append((TRIE, bucket, 0, file.read(), 0, 0, 0))
        return _frame(out, MESSAGE)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        g = grams(table, told)
        one = (g.counts + 0.5) / (every + 0.5 * (kinds + 1))
        n = len(g.sizes)
        doc = np.repeat(np.arange(n), g.sizes)
        base = np.bincount(doc, np.log10(one)[g.word], n)
        total = np.bincount(doc, np.log10(g.probabilities(_by_bucket(told, ANSWERS), one)), n)
        seen = np.bincount(doc, (g.counts > 0)[g.word], n).astype(np.int64)
        columns = [table["doc_ids"][0].as_py(), table["held_out"][0].as_py(), g.sizes, seen, np.full(n, every), base, total]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    chunks = texts.select("chunk", "doc_ids", "held_out", "sizes", "words", "uses", "end").groupBy("chunk")
    answers = chunks.cogroup(counted.groupBy("chunk")).applyInArrow(send, MESSAGE_SQL).groupBy("bucket").applyInArrow(shard, MESSAGE_SQL)
    if model:
        answers = scratch.save(answers, "answers")
        answers.filter(F.col("kind") == TRIE).select("bucket", "payload").write.mode("overwrite").parquet(model)
        answers = answers.filter(F.col("kind") == ANSWERS)
    told = counted.unionByName(answers)
    return chunks.cogroup(told.groupBy("chunk")).applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
