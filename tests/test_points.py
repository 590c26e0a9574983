import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from voxelweave.functions import curves
from voxelweave.functions.lattice import Adaptive, lattice
from voxelweave.operators import blocks, cells as C, codec, ordered, partition, points as P, quality, sizing
from voxelweave.plans import compress as Z, reports
from voxelweave.sources import raw

SCHEMA = "id long, x float, y float, z float"


def cloud(spark, xyz):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], SCHEMA)


def cells(spark, xyz, name="to", bound=0.5):
    lat = lattice(name, bound)
    return P.recover(P.quantize(P.shift(cloud(spark, xyz)), lat), lat)


@pytest.mark.parametrize("name", ["to", "cube"])
@pytest.mark.parametrize("bound", [0.01, 0.5])
def test_error_stays_under_the_bound(spark, name, bound):
    xyz = np.random.default_rng(1).uniform(-5, 5, (5000, 3)).astype(np.float32)
    got = quality.error_stats(quality.with_error(cells(spark, xyz, name, bound)), bound * (1 + 1e-4)).first()
    assert got["n"] == 5000 and got["overflow"] == 0 and got["max_err"] > 0.9 * bound


def test_flat_axis_gives_cell_minus_one_and_survives_the_keys(spark):
    xyz = [(a / 7, b / 5, 2.0) for a in range(30) for b in range(30)]
    q = cells(spark, xyz, "to", 0.5)
    assert q.agg(F.min("qz")).first()[0] == -1
    keyed = blocks.direct_keys(q, bias=curves.Z_BIAS)
    back = curves.with_morton_cell(keyed.drop("qx", "qy", "qz"), F.col("sfc")).select("id", "qx", "qy", (F.col("qz") - curves.Z_BIAS).alias("qz"))
    assert back.exceptAll(q.select("id", "qx", "qy", "qz")).count() == 0


def test_edge_clouds(spark):
    assert cells(spark, []).count() == 0
    one = cells(spark, [(1.5, -2, 3)]).first()
    assert (one["qx"], one["qy"], one["qz"]) == (0, 0, 0) and (one["ox"], one["oy"], one["oz"]) == (1.5, -2.0, 3.0)
    same = C.duplicate_ratio(C.cell_counts(cells(spark, [(1, 2, 3)] * 10))).first()
    assert (same["points"], same["cells"], round(same["ratio"], 9)) == (10, 1, 0.9)
    assert quality.error_stats(quality.with_error(cells(spark, [(1, 2, 3)] * 10)), 1).first()["psnr"] is None
    assert C.duplicate_ratio(C.cell_counts(cells(spark, []))).first()["ratio"] == 0


def test_cube_floors_at_cell_borders(spark):
    step = 2 * float(np.float32(0.5)) / math.sqrt(3)
    got = cells(spark, [(0, 0, 0), (step * 3, step, 0)], "cube").orderBy("id").collect()
    assert got[1]["qx"] in (2, 3) and got[0]["qx"] == 0


def test_nulls_and_nan_are_left_out(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0), (2, None, 1.0, 1.0), (3, float("nan"), 1.0, 1.0), (4, float("inf"), 1.0, 1.0)], SCHEMA)
    assert [r["id"] for r in P.finite(df).collect()] == [1]


def test_wrong_names_raise():
    with pytest.raises(ValueError):
        lattice("hexagon", 1)
    with pytest.raises(ValueError):
        lattice("to", 0)
    with pytest.raises(ValueError):
        Z.Options(curve="peano")
    with pytest.raises(ValueError):
        partition.check_mode("morton-ish")
    with pytest.raises(ValueError):
        P.tiles(F.lit(10), 5)


def test_adaptive_handles_a_flat_axis(spark):
    df = cloud(spark, [(0, 0, 1), (3, 4, 1)])
    fitted = Adaptive.fit(df, 0.5)
    assert [round(s, 6) for s in fitted.steps] == [0.3, 0.4, 0.0]
    got = P.recover(P.quantize(P.shift(df), fitted), fitted).orderBy("id").collect()
    assert (got[1]["qx"], got[1]["qy"], got[1]["qz"]) == (10, 10, 0)


def test_hilbert_is_a_walk(spark):
    rows = spark.range(4096).withColumn("h", curves.hilbert(F.col("id"), 3))
    rows = curves.with_morton_cell(rows, F.col("id")).withColumn("back", curves.hilbert_morton(F.col("h"), 3)).orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(4096)) and all(r["back"] == r["id"] for r in rows)
    at = [(r["qx"], r["qy"], r["qz"]) for r in rows]
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(at, at[1:]))


def test_cells_too_far_out_raise(spark):
    far = spark.createDataFrame([(1 << 21, 0, 0)], "qx int, qy int, qz int")
    with pytest.raises(Exception, match="outside"):
        blocks.direct_keys(far).collect()


def test_superblocks_and_octants(spark):
    rows = spark.createDataFrame([(63, 0, 0), (64, 0, 0), (127, 64, 0), (128, 0, 64)], "qx int, qy int, qz int")
    got = {(r["qx"], r["qy"], r["qz"]): (r["id"], r["quad"], r["sfc"]) for r in blocks.entries(rows).collect()}
    assert got[63, 0, 0][:2] == (0, 0) and got[64, 0, 0][:2] == (0, 1) and got[127, 64, 0][:2] == (0, 3) and got[128, 0, 64][:2] == (1, 4)
    back = blocks.cells_of(blocks.entries(rows, True).drop("qx", "qy", "qz"), True)
    assert {(r["qx"], r["qy"], r["qz"]) for r in back.collect()} == set(got)


def test_order_operators_across_buckets(spark):
    keys = np.random.default_rng(3).integers(0, 10**6, 3000)
    df = spark.createDataFrame([(int(k), i) for i, k in enumerate(keys)], "k long, id long")
    want = sorted((int(k), i) for i, k in enumerate(keys))
    got = ordered.ranked(df, "k", ["id"]).orderBy("rank").collect()
    assert [(r["k"], r["id"]) for r in got] == want and [r["rank"] for r in got] == list(range(1, 3001))
    d = ordered.deltas(df, "k", ["id"])
    assert d.agg(F.sum("delta")).first()[0] == max(keys) and d.agg(F.min("delta")).first()[0] >= 0


def test_patches(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0, 253, 254, 255, 10**9, 5])], "i long, v long")
    symbols, patches = sizing.split_patches(df, "v", "i")
    assert [r["symbol"] for r in symbols.orderBy("i").collect()] == [1, 254, 255, 0, 0, 6]
    assert [r["patch"] for r in patches.orderBy("patch_no").collect()] == [255, 10**9]
    assert [r["value"] for r in sizing.merge_patches(symbols, patches, "i").orderBy("i").collect()] == [0, 253, 254, 255, 10**9, 5]


values = st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**62)), max_size=60).map(lambda v: np.array(v, np.uint64))


@settings(max_examples=40, deadline=None)
@given(values)
def test_codecs_round_trip(v):
    for name, encode in codec.ENCODERS.items():
        assert codec.DECODERS[name](*encode(v)).tolist() == v.tolist(), name


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(0, 255), st.integers(1, 10**6), min_size=2, max_size=60))
def test_huffman_is_near_entropy(freq):
    n = sum(freq.values())
    lengths = codec.code_lengths(freq)
    bits = sum(freq[s] * length for s, length in lengths.items()) / n
    entropy = -sum(f / n * math.log2(f / n) for f in freq.values())
    assert entropy - 1e-9 <= bits < entropy + 1 and sum(2.0**-v for v in lengths.values()) <= 1


def test_codec_details():
    assert codec.code_lengths({7: 3}) == {7: 1} and codec.bitpack(np.zeros(0)) == (b"", b"")
    assert codec.bitpack(np.array([5, 1]))[0] == b"\x02\x00\x00\x00\x03"
    with pytest.raises(ValueError):
        codec.unhuffman(*(lambda m, d: (m, d[:0]))(*codec.huffman(np.array([1, 2, 3]))))
    assert codec.unzstd(codec.zstd(b"abc" * 50)) == b"abc" * 50
    skew = {i: 2**min(i, 50) for i in range(60)}
    assert max(codec.code_lengths(skew).values()) <= codec.MOST_LENGTH


@pytest.mark.parametrize("curve", ["z", "hilbert"])
@pytest.mark.parametrize("rle", [True, False])
def test_compress_keeps_points_in_bound(spark, curve, rle):
    xyz = np.random.default_rng(5).uniform(0, 3, (600, 3)).astype(np.float32)
    df = cloud(spark, xyz).withColumn("chunk", (F.col("id") % 3).cast("int"))
    got = np.array([[r["x"], r["y"], r["z"]] for r in Z.decompress(Z.compress(df, Z.Options("to", 0.1, curve, rle))).collect()])
    assert len(got) == 600
    assert max(np.linalg.norm(got - p, axis=1).min() for p in xyz) <= 0.1 * 1.001


@pytest.mark.parametrize("mode", partition.MODES)
def test_partitioners(spark, mode):
    xyz = np.random.default_rng(6).uniform(0, 30, (2000, 3))
    counts = C.cell_counts(cells(spark, xyz, "to", 1.0))
    owned = partition.with_owner(counts, 4, mode)
    assert owned.count() == counts.count() and {r["owner"] for r in owned.select("owner").distinct().collect()} <= {0, 1, 2, 3}
    assert partition.deal(counts, 4, mode).agg(F.sum("cnt")).first()[0] == 2000


def test_cell_table_on_disk(spark, tmp_path):
    xyz = np.random.default_rng(7).uniform(0, 3, (300, 3))
    Z.write_cells(cloud(spark, xyz), Z.Options("to", 0.5), str(tmp_path / "t"))
    assert Z.read_cells(spark, str(tmp_path / "t")).count() == 300
    assert spark.read.json(str(tmp_path / "t/manifest")).agg(F.sum("input_bytes")).first()[0] == 3600


def test_raw_files(spark, tmp_path):
    xyz = np.arange(30, dtype="<f4").reshape(10, 3)
    path = tmp_path / "p.bin"
    path.write_bytes(xyz.tobytes() + b"abc")
    assert raw.file_size(str(path)) == 123 and raw.read_points(spark, str(path)).count() == 10
    got = raw.read_points(spark, str(path), 24, 36).orderBy("index").collect()
    assert [r["index"] for r in got] == [2, 3, 4] and got[0]["x"] == 6.0
    assert raw.read_points(spark, str(path), 1200).count() == 0 and raw.read_points(spark, str(path), 96, 12000).count() == 2
    with pytest.raises(ValueError):
        raw.byte_range(100, 5)
    raw.write_points(raw.read_points(spark, str(path)), str(tmp_path / "out"))
    assert [r["rank"] for r in raw.parts(spark, str(tmp_path / "out")).collect()] == [0]
    assert raw.blob_points(raw.read_blobs(spark, str(tmp_path / "out"))).count() == 10


def test_appends_and_overwrites(spark, tmp_path):
    at = str(tmp_path / "out")
    two = spark.createDataFrame([(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)], "x float, y float, z float").coalesce(1)
    values = lambda: sorted(r["x"] for r in raw.blob_points(raw.read_blobs(spark, at)).collect())
    raw.write_points(two, at)
    raw.write_points(two.withColumn("x", F.col("x") + 10), at)
    assert values() == [1.0, 4.0, 11.0, 14.0] and [r["rank"] for r in raw.parts(spark, at).collect()] == [0, 1]
    raw.write_points(two.repartition(3), at, "append")
    assert values() == [1.0, 1.0, 4.0, 4.0, 11.0, 14.0]
    raw.write_points(two, at, "overwrite")
    assert values() == [1.0, 4.0] and sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["part_rank0000.bin"]


def test_scalars_and_summaries(spark, tmp_path):
    errors = spark.range(10).select((F.col("id") / 4).alias("err")).coalesce(1)
    raw.write_scalars(errors, "err", str(tmp_path / "err"))
    got = raw.read_scalars(spark, str(tmp_path / "err/part_rank0000.bin"), 8, 12).orderBy("index").collect()
    assert [(r["index"], r["value"]) for r in got] == [(2, 0.5), (3, 0.75), (4, 1.0)]
    ranks = spark.createDataFrame([(0, 120, 12, 1, 2.0), (1, 240, 12, 2, 4.0)], "rank long, input_bytes long, compressed_bytes long, blocks long, wall_s double")
    raw.write_summary(reports.run_summary(ranks), str(tmp_path / "s_n2/blk64M"))
    got = raw.read_summaries(spark, str(tmp_path), "s").collect()
    assert [(r["nodes"], r["block_mib"], r["nranks"], r["input_bytes"], len(r["per_rank"])) for r in got] == [(2, 64, 2, 360, 2)]


@pytest.mark.parametrize("name", ["to", "cube", "adaptive"])
@pytest.mark.parametrize("mode", ["direct", "block"])
def test_modes_and_lattices_in_one_table(spark, name, mode):
    xyz = np.random.default_rng(9).uniform(0, 300, (400, 3)).astype(np.float32)
    df = cloud(spark, xyz).withColumn("chunk", (F.col("id") % 2).cast("int"))
    bound = 0.2 if name != "adaptive" else 0.001
    streams = Z.compress(df, Z.Options(name, bound, "z", True, mode)).unionByName(Z.compress(df, Z.Options("cube", 0.5)).withColumn("chunk", F.col("chunk") + 10))
    assert {r["mode"] for r in streams.filter("chunk < 10").collect()} == {mode}
    back = np.array([[r["x"], r["y"], r["z"]] for r in Z.decompress(streams).filter("chunk < 10").collect()])
    limit = 0.2 if name != "adaptive" else 0.001 * 300
    assert len(back) == 400 and max(np.linalg.norm(back - p, axis=1).min() for p in xyz) <= limit * 1.001
    other = np.array([[r["x"], r["y"], r["z"]] for r in Z.decompress(streams).filter("chunk >= 10").collect()])
    assert len(other) == 400 and max(np.linalg.norm(other - p, axis=1).min() for p in xyz) <= 0.5 * 1.001


def test_empty_streams_and_points(spark):
    none = cloud(spark, np.zeros((0, 3))).withColumn("chunk", F.lit(0))
    assert Z.compress(none, Z.Options()).count() == 0 and Z.decompress(Z.compress(none, Z.Options())).count() == 0


def test_columns_of_users_stay(spark):
    names = ["_q_ux", "_m0", "_b", "_z", "_s", "_n", "_e", "_x", "a.b"]
    df = cloud(spark, np.random.default_rng(2).uniform(0, 9, (20, 3)))
    for n in names:
        df = df.withColumn(n, F.lit("kept"))
    q = P.quantize(df, lattice("to", 0.5))
    keys = blocks.direct_keys(q, hilbert=True, bias=2)
    entries = blocks.entries(q, bias=2)
    got = ordered.ranked(ordered.deltas(keys, "sfc", ["id"]), "sfc", ["id"])
    for t in (q, keys, entries, blocks.cells_of(entries.drop("qx", "qy", "qz"), bias=2), got, C.expand(q.withColumn("cnt", F.lit(2).cast("long")))):
        row = t.first().asDict()
        assert all(row[n] == "kept" for n in names)


def test_frequent_keys_are_cut_by_ties(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKET_ROWS", 50)
    keys = [7] * 2000 + [9] * 700 + list(range(300))
    random.Random(4).shuffle(keys)
    df = spark.createDataFrame(list(zip(keys, range(3000))), "k long, id long")
    sizes = ordered.bucketed(df, "k", ["id"]).groupBy("_b").count().agg(F.max("count")).first()[0]
    assert sizes <= 120
    want = sorted(zip(keys, range(3000)))
    got = ordered.ranked(df, "k", ["id"]).orderBy("rank").collect()
    assert [(r["k"], r["id"]) for r in got] == want and [r["rank"] for r in got] == list(range(1, 3001))
    d = ordered.deltas(df, "k", ["id"]).orderBy("k", "id").collect()
    assert [r["delta"] for r in d] == [want[0][0], *(b[0] - a[0] for a, b in zip(want, want[1:]))]


def test_decoders_stop_at_cut_streams():
    v = np.random.default_rng(1).integers(0, 2**40, 200, dtype=np.uint64)
    for name, encode in codec.ENCODERS.items():
        meta, data = encode(v)
        with pytest.raises(ValueError):
            codec.DECODERS[name](meta, data[: len(data) // 2])


def test_summaries_and_scaling(spark, tmp_path):
    for n, wall in ((1, 8.0), (2, 5.0)):
        at = tmp_path / f"sweep_n{n}" / "blk64M"
        at.mkdir(parents=True)
        (at / "summary.json").write_text('{"nranks": %d, "input_bytes": 100, "compressed_bytes": 10, "wall_max_s": %f, "end_to_end_throughput_GBps": %f}' % (n, wall, 100 / wall))
    got = raw.read_summaries(spark, str(tmp_path), "sweep")
    scaled = reports.scaling(got.withColumn("throughput", F.col("end_to_end_throughput_GBps"))).orderBy("nodes").collect()
    assert [round(r["speedup"], 3) for r in scaled] == [1.0, 1.6] and round(scaled[1]["parallel_efficiency"], 3) == 0.8


def test_streamed_counts(spark, tmp_path):
    from voxelweave.streaming.cells import stream_cell_counts, stream_points

    df = cloud(spark, np.random.default_rng(8).uniform(0, 9, (500, 3)))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    lat = lattice("to", 1.0)
    counts = stream_cell_counts(stream_points(spark, str(tmp_path / "in"), df.schema, 1), lat, (0.0, 0.0, 0.0))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("streamed").start()
    try:
        q.processAllAvailable()
        want = C.cell_counts(P.quantize(df, lat))
        assert spark.table("streamed").exceptAll(want).count() == 0 and spark.table("streamed").count() == want.count()
    finally:
        q.stop()


def test_expand_splits_hot_cells(spark):
    df = spark.createDataFrame([(0, 0, 0, 25_000), (1, 0, 0, 3)], "qx int, qy int, qz int, cnt long")
    got = C.expand(df).groupBy("qx").count().collect()
    assert {r["qx"]: r["count"] for r in got} == {0: 25_000, 1: 3}
