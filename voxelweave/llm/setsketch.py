"""Near-duplicate documents by SetSketch registers.

A document is its set of shingles of `width` words, five unless told otherwise (words lower-cased in A-Z; with fewer words the whole
sequence as one shingle; without words the empty set, which is linked with nothing).
SetSketch (Ertl, 2021): register i holds floor(1 - log_b x_i), where x_i is the least
of the exponential values that the set's elements draw for it, so values are
exponentially spaced, truncated to 16 bits, mergeable by maximum, and equal with a
chance that follows the sets' likeness. Elements draw their values in ascending order over
the registers, so elements whose next value is above all of the minima stop early.

1. Equal sets become one node. 2. Bands of ROWS registers are hashed; nodes that share a
band meet in a bucket. 3. In each bucket a node is paired with the first node and the one
before it, which joins groups of copies without making all pairs. 4. The joint likelihood
of two sketches under the likeness J drops pairs that are far below the limit, and
what is left is confirmed on the full sets. 5. Buckets that still hold several components are gone
through once more. Their nodes outside the largest component (the minor ones) and the rest (the major
ones) are dealt over blocks of bounded rows and shingles, and each pair of blocks, but for two major
ones, is a group of its own that any task may take. In it each likely pair of different components
is confirmed on the full sets, in the one band that it shares first. What links joins its components at once. Nothing but links is
emitted: at most one for each node of a group.

Buckets that hold a large share of a sample of all nodes are dealt over parts in step 3, and the parts' first
nodes are chained, so no bucket is one task's alone. Sketches are compared for all pairs
of minor nodes of an open bucket: where a third of all texts are alike, but not enough to be linked, that work
grows with the square of their number, as no banding tells 0.7 from 0.8 for certain.

At the limit J = 0.8 a pair shares no band with a chance of (1 - 0.8**4)**40 = 7e-10, at 0.85 of 2e-13.
A pair at the limit is dropped by its estimate with a chance of about 1e-9 (6 standard deviations).
Sets are compared as 64-bit digests of their shingles; nodes are 63-bit digests of sets.

Defined cases: null and empty texts have n_shingles 0 and are their own component;
rows that share a doc_id each have the component of their own text; rows with a null
doc_id are linked with nothing, have a null component and are kept; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .graph import components
from .scratch import Scratch, fresh, named
from .text import BASE_A, U, mix, word_hashes

REGISTERS, ROWS = 160, 4
WORDS, LIMIT = 5, 0.8
SPACING, RATE = 1.001, 20.0
#: A pair is dropped unread if its estimate is so many standard deviations below the limit.
DEVIATIONS = 6.0
#: Rows compared at once; rows and shingles that a block of an open bucket aims at, of minor and of major nodes.
BLOCK = 2048
MINOR, MAJOR = (512, 1 << 19), (1024, 1 << 20)
#: A bucket with such a share of the sampled nodes is dealt over PARTS; so there are at most REGISTERS / ROWS / SHARE of them.
SAMPLE, SHARE, PARTS = 20_000, 1 / 500, 64


def shingle_sets(column, width: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle digests of each text."""
    h, _, counts = word_hashes(column, lower=True)
    n = len(counts)
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(n), counts)
    value = h.copy()
    for k in range(1, width):
        value = mix(value[: len(h) - k] * U(BASE_A) + h[k:]) if len(h) > k else np.zeros(0, np.uint64)
    whole = np.arange(len(value)) + width <= ends[doc[: len(value)]] if len(value) else np.zeros(0, bool)
    value, owner = value[whole], doc[: len(whole)][whole]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):  # the whole sequence, marked as such
        only = []
        for d in short:
            x = np.array([counts[d]], np.uint64)
            for w in h[ends[d] - counts[d] : ends[d]]:
                x = mix(x * U(BASE_A) + w + U(1))
            only.append(x[0])
        value, owner = np.concatenate((value, np.array(only, np.uint64))), np.concatenate((owner, short))
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return np.split(value, np.searchsorted(owner, np.arange(1, n))) if n else []


def _bounds(m: int) -> np.ndarray:
    j = np.arange(m, dtype=np.float64)
    return np.append(np.log1p(j / (m - j)), np.inf) / RATE


def sketches(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """One row of uint16 registers for each set; an empty set has zeros."""
    out = np.zeros((len(sets), m), np.uint16)
    first = 0
    while first < len(sets):
        last, size = first, 0
        while last < len(sets) and (last == first or size + len(sets[last]) <= 200_000):
            size += len(sets[last])
            last += 1
        out[first:last] = _sketches(sets[first:last], m)
        first = last
    return out


def _sketches(sets: list[np.ndarray], m: int) -> np.ndarray:
    sizes = np.array([len(s) for s in sets])
    least = np.full(len(sets) * m, np.inf)
    element = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    gamma = _bounds(m)
    draw = mix(element ^ U(0x5851F42D4C957F2D))
    start = (draw >> U(40)).astype(np.int64) % m
    coprime = np.array([k for k in range(1, m) if math.gcd(k, m) == 1])
    stride = coprime[(draw >> U(8)).astype(np.int64) % len(coprime)]  # visits each register once
    for j in range(m):
        if not len(element):
            break
        uniform = (mix(element + U((j + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> U(11)).astype(np.float64) / 2**53
        low, high = gamma[j], gamma[j + 1]
        # an exponential value, truncated to [low, high)
        x = low - np.log1p(-uniform * -np.expm1(-RATE * (high - low))) / RATE if np.isfinite(high) else low - np.log1p(-uniform) / RATE
        np.minimum.at(least, owner * m + (start + j * stride) % m, x)
        worst = least.reshape(-1, m).max(1)
        alive = worst[owner] > high
        element, owner, start, stride = element[alive], owner[alive], start[alive], stride[alive]
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(least) / np.log(SPACING))
    k[~np.isfinite(least)] = 0
    return np.clip(k, 0, 65535).astype(np.uint16).reshape(-1, m)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def joint_estimate(a: np.ndarray, b: np.ndarray, na, nb) -> np.ndarray:
    """Maximum-likelihood Jaccard likeness of rows of registers, the set sizes being known.

    With u, v the share of each set in the sum of sizes, a register of the first is the
    greater with probability p(u - v J), of the second with p(v - u J), where
    p(x) = -log_b(1 - x (b-1)/b); both equal otherwise.
    """
    na, nb = np.asarray(na, np.float64), np.asarray(nb, np.float64)
    up, down = (a > b).sum(-1), (a < b).sum(-1)
    same = a.shape[-1] - up - down
    u, v = na / (na + nb), nb / (na + nb)
    most = np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, None) * (SPACING - 1) / SPACING) / np.log(SPACING)

    def likelihood(j):
        first, second = p(u - v * j), p(v - u * j)
        return up * np.log(first) + down * np.log(second) + same * np.log(np.maximum(1 - first - second, 1e-12))

    # the logarithm of the likelihood is concave in J: golden-section search
    low, high, ratio = np.zeros_like(u), most.copy(), (np.sqrt(5) - 1) / 2
    for _ in range(24):
        x, y = high - ratio * (high - low), low + ratio * (high - low)
        left = likelihood(x) > likelihood(y)
        high, low = np.where(left, y, high), np.where(left, low, x)
    return (low + high) / 2


def likely(a: np.ndarray, b: np.ndarray, na, nb, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """(whether a pair may reach the limit, its estimate)."""
    got = joint_estimate(a, b, na, nb)
    spread = np.sqrt(limit * (1 - limit) / a.shape[-1])
    na, nb = np.asarray(na), np.asarray(nb)
    return (np.minimum(na, nb) >= limit * np.maximum(na, nb) - 1e-9) & (got >= limit - DEVIATIONS * spread), got


def _registers(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), -1)


def _node(s: np.ndarray) -> int | None:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little") >> 1 if len(s) else None


def signatures(rows: DataFrame, width: int) -> DataFrame:
    """doc_id, text_key, n, node (digest of the set; null if empty), sketch of (doc_id, text_key, text) rows."""
    names = ["doc_id", "text_key", "n", "node", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, 500):
                part = b.slice(first, 500)
                sets = shingle_sets(part.column(2), width)
                registers = sketches(sets).astype("<u2")
                nodes = [_node(s) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array([r.tobytes() if n is not None else None for r, n in zip(registers, nodes)], pa.binary())], names)

    return rows.select("doc_id", "text_key", "text").mapInArrow(run, "doc_id long, text_key long, n long, node long, sketch binary")


def node_sets(texts: DataFrame, width: int) -> DataFrame:
    """node, shingles (the set's 64-bit digests) of (node, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, 500):
                part = b.slice(first, 500)
                sets = shingle_sets(part.column(1), width)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles binary")


def bands(nodes: DataFrame) -> DataFrame:
    """(key, band, node, n): a row for each band of each node's registers."""
    width = 2 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // ROWS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sketch"), i * width + 1, F.lit(width))))
    return nodes.select("node", "n", F.posexplode(keys).alias("band", "key"))


def confirm(pairs: DataFrame, sketched: DataFrame, sets: DataFrame, limit: float) -> DataFrame:
    """The pairs (a, b) whose full sets have Jaccard likeness of limit or more; sketches first drop those that can't."""
    percent = round(limit * 100)
    own = lambda df, side, name: df.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in name])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
                ok, _ = likely(_registers(col["sketch_a"]), _registers(col["sketch_b"]), col["n_a"].to_numpy(), col["n_b"].to_numpy(), limit)
                yield pa.RecordBatch.from_arrays([col["a"], col["b"]], ["a", "b"]).filter(pa.array(ok))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                b = batch.slice(first, 500)
                keep = []
                for x, y in zip(b.column(2), b.column(3)):
                    keep.append(_reaches(x.as_buffer(), y.as_buffer(), limit))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    some = pairs.join(own(sketched, "a", ("n", "sketch")), "a").join(own(sketched, "b", ("n", "sketch")), "b")
    some = some.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent).select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
    some = some.mapInArrow(near, "a long, b long")
    full = some.join(own(sets, "a", ("shingles",)), "a").join(own(sets, "b", ("shingles",)), "b").select("a", "b", "shingles_a", "shingles_b")
    return full.mapInArrow(exact, "a long, b long")


class _Group:
    """A pair of blocks of one bucket and band, as their rows come; links between components are found as soon as both sides are there.

    A pair is looked at in the first band that it shares, so once in all, and only while its sides are in different components.
    """

    def __init__(self, band: int, limit: float, one: bool):
        self.band, self.limit, self.one, self.parent, self.held, self.links = band, limit, one, {}, [], []

    def find(self, r: int) -> int:
        while (up := self.parent.get(r, r)) != r:
            self.parent[r] = r = self.parent.get(up, up)
        return r

    def add(self, part: dict, first: int) -> None:
        """Rows of the group; `first` of them, at the front, are of its first block and are held for what follows. If `one`, that block's own pairs count too."""
        own, rest = {n: v[:first] for n, v in part.items()}, {n: v[first:] for n, v in part.items()}
        for x in self.held:
            if self.one:
                self.match(x, own, False)
            self.match(x, rest, False)
        if first:
            if self.one:
                self.match(own, own, True)
            self.match(own, rest, False)
            self.held.append(own)

    def match(self, x: dict, y: dict, same: bool) -> None:
        if not len(x["node"]) or not len(y["node"]):
            return
        rx, ry = (np.array([self.find(r) for r in t["root"].tolist()]) for t in (x, y))
        least = REGISTERS * (self.limit - (DEVIATIONS + 1) * np.sqrt(self.limit * (1 - self.limit) / REGISTERS))
        found = []
        for first in range(0, len(rx), 8):
            rows = slice(first, first + 8)
            apart = rx[rows, None] != ry[None, :]
            if same:
                apart &= np.arange(first, first + len(apart))[:, None] < np.arange(len(ry))[None, :]
            i, j = np.nonzero(apart)
            if not len(i):
                continue
            i += first
            equal = x["sketch"][i] == y["sketch"][j]
            ok = equal.sum(1) >= least
            ok &= equal.reshape(len(i), -1, ROWS).all(2).argmax(1) == self.band
            found.append((i[ok], j[ok]))
        if not found:
            return
        i, j = (np.concatenate(c) for c in zip(*found))
        ok, estimate = likely(x["sketch"][i], y["sketch"][j], x["n"][i], y["n"][j], self.limit)
        i, j, estimate = i[ok], j[ok], estimate[ok]
        if len(i) > 4 * (len(rx) + len(ry)):  # many pairs that didn't join: all of a row's intersections at once
            both = self.shared(x, y, i, j)
            ok = 100 * both >= round(self.limit * 100) * (x["n"][i] + y["n"][j] - both)
            for k in np.flatnonzero(ok).tolist():
                self.link(x, y, int(i[k]), int(j[k]))
            return
        for k in np.argsort(-estimate, kind="stable").tolist():
            a, b = int(i[k]), int(j[k])
            if self.find(int(x["root"][a])) != self.find(int(y["root"][b])) and _reaches(x["shingles"][a], y["shingles"][b], self.limit):
                self.link(x, y, a, b)

    def shared(self, x: dict, y: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of x's sets i with y's sets j; i ascends."""
        sets = [np.frombuffer(s, "<u8") for t in (x, y) for s in t["shingles"]]
        sizes = np.array([len(s) for s in sets])
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
        ends = np.cumsum(sizes)
        k = len(x["node"])
        theirs, starts = ids[ends[k - 1] :], (ends - sizes)[k:] - ends[k - 1]
        mark, out = np.zeros(int(ids.max()) + 1, bool), np.zeros(len(i), np.int64)
        cuts = np.flatnonzero(np.diff(i)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(i)]):
            own = ids[ends[i[a]] - sizes[i[a]] : ends[i[a]]]
            mark[own] = True
            out[a:b] = np.add.reduceat(mark[theirs], starts, dtype=np.int64)[j[a:b]]
            mark[own] = False
        return out

    def link(self, x: dict, y: dict, i: int, j: int) -> None:
        a, b = self.find(int(x["root"][i])), self.find(int(y["root"][j]))
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((int(x["node"][i]), int(y["node"][j])))


def _reaches(x: bytes, y: bytes, limit: float) -> bool:
    """Whether two full sets (sorted 64-bit digests) have Jaccard likeness of limit or more."""
    x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= round(limit * 100) * (len(x) + len(y) - both)


def _links(limit: float):
    """Links (a, b) between components from rows sorted by group (key, band, i, j) and side: the first block is held, the other streams past it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, None

        def links(group):
            if group and group.links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*group.links)], ["a", "b"])

        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                b = batch.slice(first, BLOCK)
                col = {n: b.column(k) for k, n in enumerate(b.schema.names)}
                keys = np.stack([col[n].to_numpy().astype(np.int64) for n in ("key", "band", "i", "j")], 1)
                side = col["side"].to_numpy()
                whole = {n: col[n].to_numpy() for n in ("node", "root", "n")} | {"sketch": _registers(col["sketch"]), "shingles": np.array(col["shingles"].to_pylist(), object)}
                cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
                for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                    if tuple(keys[lo]) != at:
                        yield from links(group)
                        at = tuple(keys[lo])
                        group = _Group(int(at[1]), limit, at[2] == at[3])
                    group.add({n: v[lo:hi] for n, v in whole.items()}, int((side[lo:hi] == 0).sum()))
        yield from links(group)

    return run


def hot_buckets(nodes: DataFrame) -> DataFrame:
    """(key, band) of the buckets that hold a large share of a sample of the nodes. They are only dealt otherwise; what is compared stays the same."""
    every = max(1, nodes.count() // SAMPLE)
    few = nodes.filter(F.pmod(F.xxhash64("node"), F.lit(every)) == 0)
    least = max(16, int(few.count() * SHARE))
    return bands(few).groupBy("key", "band").agg(F.count("*").alias("c")).filter(F.col("c") >= least).select("key", "band", F.lit(True).alias("hot"))


def meetings(nodes: DataFrame) -> DataFrame:
    """(key, band, node, n, before, first, hot) of all nodes in buckets of several; before and first are null for the first node of a bucket or of a hot bucket's part."""
    placed = bands(nodes).join(F.broadcast(hot_buckets(nodes)), ["key", "band"], "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    # by node alone: nodes that meet in several bands then make the same pairs in each
    placed = placed.withColumn("part", F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.lit(PARTS))).otherwise(F.lit(0)).cast("int"))
    order = Window.partitionBy("key", "band", "part").orderBy("node")
    met = placed.withColumns({"before": F.lag("node").over(order), "after": F.lead("node").over(order), "first": F.first("node").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    met = met.filter("hot or before is not null or after is not null")
    return met.select("key", "band", "node", "n", "before", F.when(F.col("before").isNotNull(), F.col("first")).alias("first"), "hot")


def chains(met: DataFrame) -> DataFrame:
    """Pairs (a, b) that join what meets: each node with its bucket's first and the one before it; the firsts of a hot bucket's parts in a chain."""
    inside = met.filter("before is not null").select(F.explode(F.array(F.struct(F.col("first").alias("a"), F.col("node").alias("b")), F.struct(F.col("before").alias("a"), F.col("node").alias("b")))).alias("p")).select("p.a", "p.b")
    parts = met.filter("hot and before is null").withColumn("a", F.lag("node").over(Window.partitionBy("key", "band").orderBy("node")))
    return inside.unionByName(parts.filter("a is not null").select("a", F.col("node").alias("b"))).distinct()


def groups(met: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, band, node, root, i, j, side): the rows of each pair of blocks of each bucket that holds several components."""
    placed = met.join(roots, F.col("node") == F.col("id"), "left").select("key", "band", "node", "n", F.coalesce("root", "node").alias("root"))
    counted = placed.groupBy("key", "band", "root").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    by = F.struct("c", "root")
    mixed = counted.groupBy("key", "band").agg(F.count("*").alias("roots"), F.max_by("root", by).alias("largest"), F.max("c").alias("rows"), F.max_by("s", by).alias("shingles"), F.sum("c").alias("all_rows"), F.sum("s").alias("all_shingles")).filter("roots > 1")
    blocks = lambda rows, shingles, most: F.greatest(F.ceil(rows / most[0]), F.ceil(shingles / most[1])).cast("int")
    mixed = mixed.select("key", "band", "largest", blocks(F.col("all_rows") - F.col("rows"), F.col("all_shingles") - F.col("shingles"), MINOR).alias("minor"), blocks(F.col("rows"), F.col("shingles"), MAJOR).alias("major"))
    rows = placed.join(mixed, ["key", "band"]).withColumn("is_major", F.col("root") == F.col("largest"))
    own = lambda n: F.pmod(F.xxhash64("node", "band"), n).cast("int")
    rows = rows.withColumn("block", F.when(F.col("is_major"), own(F.col("major"))).otherwise(own(F.col("minor"))))
    place = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    count = lambda n: F.sequence(F.lit(0), n - 1)
    block, is_major = F.col("block"), F.col("is_major").cast("int")
    alone = F.array(place(F.lit(0), F.lit(0), is_major))  # all in one group
    minors = F.transform(count(F.col("minor")), lambda k: place(F.least(k, block), F.greatest(k, block), (block > k)))
    minors = F.concat(minors, F.transform(count(F.col("major")), lambda k: place(block, -1 - k, F.lit(0))))
    majors = F.transform(count(F.col("minor")), lambda k: place(k, -1 - block, F.lit(1)))
    each = F.when((F.col("minor") == 1) & (F.col("major") == 1), alone).when(F.col("is_major"), majors).otherwise(minors)
    return rows.select("key", "band", "node", "root", F.explode(each).alias("g")).select("key", "band", "node", "root", "g.i", "g.j", "g.side")


def classes(docs: DataFrame, width: int = WORDS, limit: float = LIMIT) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, node, stands (whether it is the component's least row) of every document."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    signed = scratch.save(signatures(rows, width), "signed")
    least = F.min(F.struct("doc_id", "text_key")).alias("least")
    nodes = scratch.save(signed.filter("n > 0 and doc_id is not null").groupBy("node").agg(least, F.min("n").alias("n"), F.min("sketch").alias("sketch")), "nodes")
    met = scratch.save(meetings(nodes), "met")
    sketched = scratch.save(nodes.join(met.select("node").distinct(), "node", "left_semi"), "sketched")
    # merged at every size: a broadcast of ids would have no bound, and small inputs would take another path
    wanted = sketched.select("node", "least.doc_id", "least.text_key").hint("merge")
    texts = rows.join(wanted, ["doc_id", "text_key"]).groupBy("doc_id", "text_key").agg(F.first("node").alias("node"), F.first("text").alias("text"))
    sets = scratch.save(node_sets(texts, width), "sets")

    links = scratch.save(confirm(chains(met), sketched, sets, limit), "links")
    roots = scratch.save(components(links, scratch, "first"), "roots")
    wide = scratch.save(groups(met, roots), "open").join(sketched.select("node", "n", "sketch"), "node").join(sets, "node")
    wide = wide.repartition("key", "band", "i", "j").sortWithinPartitions("key", "band", "i", "j", "side", "node")
    more = wide.select("key", "band", "i", "j", "side", "node", "root", "n", "sketch", "shingles").mapInArrow(_links(limit), "a long, b long")
    # components so far stand for their links
    links = scratch.save(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(more), "more")
    roots = components(links, scratch, "second")
    # from nodes to rows: the least of a component's nodes' least rows
    group = nodes.join(roots, F.col("node") == F.col("id"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    group = scratch.save(group.join(group.groupBy("root").agg(F.min("least").alias("first")), "root").select("node", "first"), "classes")
    for name in ("nodes", "met", "sketched", "sets", "links", "roots", "open", "more", "first", "second"):
        scratch.drop(name)
    out = signed.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")).join(group, "node", "left")
    stands = F.col("first").isNull() | ((F.col("doc_id") == F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key")))
    return out.select("doc_id", "text_key", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"), "node", stands.alias("stands"))


def near_duplicates(docs: DataFrame, width: int = WORDS, limit: float = LIMIT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document; see the module's text."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return classes(docs, width, limit).select("doc_id", "n_shingles", "component_id", kept)


def without_near_duplicates(docs: DataFrame, width: int = WORDS, limit: float = LIMIT) -> DataFrame:
    """One row of docs for each component: of its least doc_id the text of least hash, once. Rows without a doc_id or without words stay."""
    dropped = classes(docs, width, limit).filter(~F.col("stands")).select("doc_id", "text_key").distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    id_, key, dealt, row = (fresh(docs, c) for c in ("_id", "_key", "_dealt", "_row"))
    keyed = docs.withColumns({id_: F.col("doc_id").cast("long"), key: F.xxhash64(text)})
    kept = keyed.join(dropped.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key)).hint("merge"), [id_, key], "left_anti")
    # equal rows: one stays; those without an id or without words are dealt out, as all of them stay
    alone = F.col(id_).isNull() | ~text.rlike("[^\\x20\\x09-\\x0D]")
    again = F.row_number().over(Window.partitionBy(id_, key, dealt).orderBy(id_))
    kept = kept.withColumn(dealt, F.when(alone, F.monotonically_increasing_id()).otherwise(F.lit(-1))).withColumn(row, again).filter(F.col(row) == 1)
    return kept.select(*[named(c) for c in docs.columns])
