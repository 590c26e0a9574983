"""Whole compression runs: per chunk, or with one global cell table, and the way back.

Columns stay relational up to the cells' keys; each chunk's (or part's) sorted keys then go through
the byte codecs in one task. A chunk is bounded by its definition. Every row of a stream table has its
options in it, so rows of different runs can stand in one table and a reader needs nothing else.

A chunk's keys take one of two modes. direct: one curve over the whole range. block: superblock, octant and
key inside the octant, in four streams of deltas (ids, entries a superblock, octants, keys). mode "auto"
takes direct for a chunk whose range is under DIRECT cells.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import curves
from ..functions.lattice import adaptive_cells, adaptive_steps, lattice, point_by_row
from ..operators import cells as C, codec, partition, points as P

STREAMS = (
    "chunk long, n long, raw_bytes long, ox float, oy float, oz float, payload binary, lattice string, bound double, curve string, rle boolean, "
    "mode string, range_x long, range_y long, steps array<double>, count_code string"
)
MODES, DIRECT = ("auto", "direct", "block"), 1024


@dataclass(frozen=True)
class Options:
    """What a run needs; wrong values raise ValueError."""

    lattice: str = "to"
    bound: float = 1e-3
    curve: str = "z"
    rle: bool = True
    mode: str = "auto"

    def __post_init__(self):
        lattice("to" if self.lattice == "adaptive" else self.lattice, self.bound)
        if self.curve not in ("z", "hilbert"):
            raise ValueError(f"unknown curve {self.curve!r}; known: z, hilbert")
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}; known: {', '.join(MODES)}")


def _stream(*pairs: tuple[bytes, bytes]) -> bytes:
    """Streams one after the other: lengths of data and meta (8 bytes each), meta, data."""
    return b"".join(struct.pack("<QQ", len(d), len(m)) + m + d for m, d in pairs)


def _streams(raw: bytes) -> list[tuple[bytes, bytes]]:
    out, at = [], 0
    while at < len(raw):
        d, m = struct.unpack_from("<QQ", raw, at)
        at += 16
        out.append((raw[at : at + m], raw[at + m : at + m + d]))
        at += m + d
    return out


def _patched(values: np.ndarray, book: dict | None = None) -> list[tuple[bytes, bytes]]:
    """Outliers in Golomb-Rice, all else as symbols in Huffman."""
    values = values.astype(np.uint64)
    over = values > codec.PATCH
    return [codec.rice(values[over]), codec.huffman(np.where(over, 0, values + np.uint64(1)), book)]


def _unpatched(pairs: list[tuple[bytes, bytes]], book: dict | None = None) -> np.ndarray:
    patches, symbols = codec.unrice(*pairs[0]), codec.unhuffman(*pairs[1], book)
    values = symbols - np.uint64(1)
    values[symbols == 0] = patches
    return values.astype(np.int64)


def _with_counts(pairs: list, counts: np.ndarray | None) -> bytes:
    """The streams, then the counts' code and stream, in zstd."""
    if counts is not None:
        kind, meta, data = codec.counts_stream(counts.astype(np.uint64))
        pairs += [(kind.encode(), b""), (meta, data)]
    return codec.zstd(_stream(*pairs))


def _counts(pairs: list) -> np.ndarray | None:
    return codec.DECODERS[pairs[0][0].decode()](*pairs[1]) if pairs else None


def encode_keys(keys: np.ndarray, counts: np.ndarray | None, book: dict | None = None) -> bytes:
    """Sorted keys as patched deltas; counts by the code that suits them."""
    return _with_counts(_patched(np.diff(keys, prepend=0), book), counts)


def decode_keys(raw: bytes, book: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    pairs = _streams(codec.unzstd(raw))
    return np.cumsum(_unpatched(pairs[:2], book)), _counts(pairs[2:])


def _restarted(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Differences that start anew where `first` says."""
    out = np.diff(values, prepend=0)
    out[first] = values[first]
    return out


def _summed(deltas: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The inverse."""
    total = np.cumsum(deltas)
    start = np.flatnonzero(first)
    return total - np.repeat(total[start] - deltas[start], np.diff(np.append(start, len(deltas))))


def _changes(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def encode_blocks(ids: np.ndarray, quads: np.ndarray, keys: np.ndarray, counts: np.ndarray | None, book: dict | None = None) -> bytes:
    """Rows sorted by (id, quad, key): superblocks' ids as bit-packed deltas, their numbers of entries as bit-packed zigzag deltas, patched deltas of octants and of keys."""
    block, octant = _changes(ids), _changes(ids, quads)
    entries = np.diff(np.append(np.flatnonzero(block), len(ids)))
    step = np.diff(entries, prepend=0)
    pairs = [codec.bitpack(np.diff(ids[block], prepend=0)), codec.bitpack((step << 1) ^ (step >> 63))]
    return _with_counts([*pairs, *_patched(_restarted(quads, block)), *_patched(_restarted(keys, octant), book)], counts)


def decode_blocks(raw: bytes, book: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    pairs = _streams(codec.unzstd(raw))
    step = codec.bitunpack(*pairs[1]).astype(np.int64)
    entries = np.cumsum((step >> 1) ^ -(step & 1))
    ids = np.repeat(np.cumsum(codec.bitunpack(*pairs[0]).astype(np.int64)), entries)
    quads = _summed(_unpatched(pairs[2:4]), _changes(ids)) if len(ids) else np.zeros(0, np.int64)
    keys = _summed(_unpatched(pairs[4:6], book), _changes(ids, quads)) if len(ids) else np.zeros(0, np.int64)
    return ids, quads, keys, _counts(pairs[6:])


OFFSETS = ["chunk", "ox", "oy", "oz", "steps"]


def _cells(points: DataFrame, options: Options) -> DataFrame:
    """Cells of each chunk's shifted points, z raised where the lattice has cells of -1, with the chunk's offset and (adaptive) steps."""
    points = P.finite(points)
    sides = [(F.max(c) - F.min(c)).alias(f"side_{c}") for c in "xyz"]
    box = points.groupBy("chunk").agg(*[F.min(c).alias(f"o{c}") for c in "xyz"], *sides)
    steps = adaptive_steps(options.bound, [F.col(f"side_{c}") for c in "xyz"]) if options.lattice == "adaptive" else F.lit(None).cast("array<double>")
    box = box.select("chunk", "ox", "oy", "oz", steps.alias("steps"))
    moved = points.join(box, "chunk").select(*OFFSETS, *[(F.col(c) - F.col(f"o{c}")).cast("float").alias(c) for c in "xyz"])
    cells = adaptive_cells(moved, F.col("steps")) if options.lattice == "adaptive" else P.quantize(moved, lattice(options.lattice, options.bound))
    return cells.select(*OFFSETS, "qx", "qy", (F.col("qz") + _bias(options.lattice)).cast("int").alias("qz"))


def _bias(name: str) -> int:
    return curves.Z_BIAS if name == "to" else 0


def _keyed(points: DataFrame, options: Options) -> DataFrame:
    """OFFSETS, mode, range_x, range_y, id, quad, sfc, cnt of each chunk's cells (or points, without rle)."""
    cells = _cells(points, options)
    if options.rle:
        cells = cells.groupBy(*OFFSETS, "qx", "qy", "qz").agg(F.count("*").alias("cnt"))
    else:
        cells = cells.withColumn("cnt", F.lit(1).cast("long"))
    top = cells.groupBy("chunk").agg(*[F.max(q).cast("long").alias(f"range_{q[1]}") for q in C.CELL])
    direct = F.lit(options.mode == "direct") if options.mode != "auto" else F.greatest("range_x", "range_y", "range_z") < DIRECT
    rows = cells.join(top, "chunk").withColumn("direct", direct)
    rows = rows.withColumn("block", curves.superblock(F.col("qx"), F.col("qy"), F.col("qz"), F.col("range_x"), F.col("range_y")))
    part = lambda name, whole: F.when(F.col("direct"), whole).otherwise(F.col(f"block.{name}"))
    rows = rows.withColumns({"id": part("id", F.lit(0).cast("long")), "quad": part("quad", F.lit(0)).cast("long"), "cx": part("lx", F.col("qx")), "cy": part("ly", F.col("qy")), "cz": part("lz", F.col("qz"))})
    cell = [F.col(c) for c in ("cx", "cy", "cz")]
    rows = curves.with_morton(rows, *cell).withColumn("sfc", curves.checked(F.col("sfc"), *cell))
    if options.curve == "hilbert":
        rows = rows.withColumn("sfc", curves.hilbert(F.col("sfc"), curves.BLOCK_ITERATION))
    return rows.select(*OFFSETS, F.when(F.col("direct"), "direct").otherwise("block").alias("mode"), "range_x", "range_y", "id", "quad", "sfc", "cnt")


def compress(points: DataFrame, options: Options, chunk: str = "chunk", book: dict | None = None) -> DataFrame:
    """A row of STREAMS for each chunk of points."""
    rows = _keyed(points.select(F.col(chunk).cast("long").alias("chunk"), "x", "y", "z"), options)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "quad", "sfc"])
        keys, cnt = pdf["sfc"].to_numpy(np.int64), pdf["cnt"].to_numpy(np.int64)
        first, counts = pdf.iloc[0], cnt if options.rle else None
        if first["mode"] == "direct":
            payload = encode_keys(keys, counts, book)
        else:
            payload = encode_blocks(pdf["id"].to_numpy(np.int64), pdf["quad"].to_numpy(np.int64), keys, counts, book)
        code = codec.counts_stream(cnt.astype(np.uint64))[0] if options.rle else None
        head = (int(first["chunk"]), len(keys), int(12 * cnt.sum()), first["ox"], first["oy"], first["oz"], payload, options.lattice, options.bound, options.curve, options.rle)
        return pd.DataFrame([(*head, first["mode"], int(first["range_x"]), int(first["range_y"]), first["steps"], code)])

    return rows.groupBy("chunk").applyInPandas(run, STREAMS)


def decompress(streams: DataFrame, book: dict | None = None) -> DataFrame:
    """chunk, x, y, z: every point's cell, as often as it has points, in the place of the original. Each row is read by its own options."""
    options = "lattice string, bound double, curve string, mode string, range_x long, range_y long, steps array<double>"
    names = [f.split()[0] for f in options.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                if r.mode == "direct":
                    keys, counts = decode_keys(bytes(r.payload), book)
                    ids = quads = np.zeros(len(keys), np.int64)
                else:
                    ids, quads, keys, counts = decode_blocks(bytes(r.payload), book)
                cnt = counts.astype(np.int64) if counts is not None else np.ones(len(keys), np.int64)
                one = {"chunk": r.chunk, "ox": np.float32(r.ox), "oy": np.float32(r.oy), "oz": np.float32(r.oz), "id": ids, "quad": quads, "sfc": keys, "cnt": cnt}
                out = pd.DataFrame(one)
                for n in names:
                    out[n] = [getattr(r, n)] * len(out) if n == "steps" else getattr(r, n)
                yield out

    rows = streams.select("chunk", "ox", "oy", "oz", "payload", *names).mapInPandas(run, f"chunk long, ox float, oy float, oz float, id long, quad long, sfc long, cnt long, {options}")
    hilbert = curves.hilbert_morton(F.col("sfc"), curves.BLOCK_ITERATION)
    rows = curves.with_morton_cell(rows.withColumn("key", F.when(F.col("curve") == "hilbert", hilbert).otherwise(F.col("sfc"))), F.col("key"), ("lx", "ly", "lz"))
    whole = curves.superblock_cell(F.col("id"), F.col("quad"), F.col("lx"), F.col("ly"), F.col("lz"), F.col("range_x"), F.col("range_y"))
    rows = rows.withColumn("block", whole)
    axis = lambda name, local: F.when(F.col("mode") == "direct", F.col(local)).otherwise(F.col(f"block.{name}"))
    bias = F.when(F.col("lattice") == "to", F.lit(curves.Z_BIAS)).otherwise(F.lit(0))
    kept = rows.select("chunk", "ox", "oy", "oz", "lattice", "bound", "steps", "cnt", axis("qx", "lx").alias("qx"), axis("qy", "ly").alias("qy"), (axis("qz", "lz") - bias).cast("int").alias("qz"))
    point = point_by_row(F.col("lattice"), F.col("bound"), F.col("steps"), F.col("qx"), F.col("qy"), F.col("qz"))
    points = kept.withColumn("point", point).select("chunk", "ox", "oy", "oz", "qx", "qy", "qz", "cnt", "point.x", "point.y", "point.z")
    return P.unshift(C.expand(points)).select("chunk", "x", "y", "z")


def fit_codebook(points: DataFrame, options: Options, chunk: str, first) -> dict:
    """A codebook over all 256 symbols, from one chunk's keys along the whole curve, for all chunks to share."""
    from dataclasses import replace

    from ..operators import sizing
    from ..operators.blocks import direct_deltas

    one = points.filter(F.col(chunk) == F.lit(first)).select(F.col(chunk).cast("long").alias("chunk"), "x", "y", "z")
    keys = _keyed(one, replace(options, mode="direct")).select("sfc")
    symbols = direct_deltas(keys).select(sizing.patched(F.col("delta"))["symbol"].alias("symbol"))
    freq = sizing.complete(sizing.frequencies(symbols, "symbol"), codec.PATCH + 1).collect()
    return codec.canonical(codec.code_lengths({r["symbol"]: r["freq"] for r in freq}))


def global_cells(points: DataFrame, options: Options, parts: int = 8, mode: str = "samplesort") -> DataFrame:
    """The cell table of all points under one offset, dealt in sorted parts: qx, qy, qz, cnt, sfc, part."""
    counts = C.cell_counts(P.quantize(P.shift(P.finite(points)), lattice(options.lattice, options.bound)))
    return partition.deal(counts, parts, mode, curves.Z_BIAS if options.lattice == "to" else 0)


def write_cells(points: DataFrame, options: Options, path: str, parts: int = 8, mode: str = "samplesort") -> None:
    """A global cell table as Parquet by part, with a one-row table of its options and offset and a manifest of its parts."""
    table = global_cells(points, options, parts, mode)
    table.write.mode("overwrite").partitionBy("part").option("compression", "zstd").parquet(f"{path}/cells")
    head = P.offset(P.finite(points)).withColumns({"lattice": F.lit(options.lattice), "bound": F.lit(float(options.bound)), "curve": F.lit(options.curve), "mode": F.lit(mode)})
    head.write.mode("overwrite").parquet(f"{path}/options")
    kept = points.sparkSession.read.parquet(f"{path}/cells")
    kept.groupBy(F.col("part").alias("rank")).agg(F.lit(mode).alias("mode"), (F.sum("cnt") * 12).alias("input_bytes"), F.count("*").alias("owned_cells")).write.mode("overwrite").json(f"{path}/manifest")


def read_cells(spark, path: str) -> DataFrame:
    """Points of a written cell table: x, y, z, each as often as it was counted."""
    head = spark.read.parquet(f"{path}/options")
    o = head.first()
    cells = spark.read.parquet(f"{path}/cells").select("qx", "qy", "qz", "cnt").crossJoin(F.broadcast(head.select("ox", "oy", "oz")))
    return P.unshift(P.recover(C.expand(cells), lattice(o["lattice"], o["bound"]), ("x", "y", "z"))).select("x", "y", "z")
