import duckdb
import pytest
from pyspark.sql import functions as F

from oracle import agree, connect
from voxelweave.operators import blocks, points as P, quality
from voxelweave.plans import queries as Q


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_agrees_with_sql(spark, data, con, name):
    agree(Q.QUERIES[name](spark, data), con, Q.ORACLES[name])


def test_codecs_lose_nothing(spark, data):
    got = Q.QUERIES["codec_roundtrip"](spark, data).collect()
    assert {r["code"] for r in got} == {"bitpack", "rice", "exp-golomb", "huffman"}
    assert all(r["wrong"] == 0 and r["n"] > 0 for r in got)


def test_codecs_get_whole_deltas(spark, data):
    groups = {}
    for r in blocks.entry_deltas(Q._entries(spark, data)).select("id", "repos_delta").collect():
        groups.setdefault(r["id"], []).append(r["repos_delta"])
    assert max(map(max, groups.values())) > 2000
    want = sum(-(-len(v) * max(1, max(v).bit_length()) // 8) for v in groups.values())
    got = {r["code"]: r for r in Q.QUERIES["codec_roundtrip"](spark, data).collect()}
    assert got["bitpack"]["data_bytes"] == want and all(r["n"] == sum(map(len, groups.values())) for r in got.values())


def test_tiles_of_all_orders_match_brute_force(spark, data, con):
    want = set()
    for key, customer in con.execute("SELECT o_orderkey, o_custkey FROM orders").fetchall():
        whole = customer * 7 // 12 * 12
        want |= {(key, at, min(1200, whole - at)) for at in range(0, whole, 1200)}
    got = [tuple(r) for r in Q.QUERIES["chunk_tiles"](spark, data).collect()]
    assert len(got) == len(want) and set(got) == want and max(r[0] for r in got) >= 200


def test_tiles_of_odd_sizes(spark):
    sizes = [0, 1, 11, 12, 13, 1199, 1200, 1201, 1212, 2400, 10**6 + 5]
    t = spark.createDataFrame([(n,) for n in sizes], "size long").select("size", F.explode(P.tiles(F.col("size"), 1207)).alias("t")).select("size", "t.offset", "t.count")
    assert sorted(map(tuple, t.collect())) == [(n, at, min(1200, n // 12 * 12 - at)) for n in sizes for at in range(0, n // 12 * 12, 1200)]


def test_rows_of_tiles_of_odd_sizes(spark):
    sizes = [None, -13, 0, 1, 11, 12, 13, 1199, 1200, 1201, 1212, 2400, 10**6 + 5, 1200 * 4096, 1200 * 4096 + 12, 3 * 1200 * 4096 - 1]
    t = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "i int, size long")
    want = [(n, at, min(1200, n // 12 * 12 - at)) for n in sizes if n for at in range(0, n // 12 * 12, 1200)]
    assert sorted(map(tuple, P.tile_rows(t, "size", 1207, ["i"]).select("size", "offset", "count").collect())) == sorted(want)
    assert P.tile_rows(t.filter("size < 12"), "size", 1200, ["i"]).count() == 0
    with pytest.raises(ValueError):
        P.tile_rows(t, "size", 11, ["i"])


def test_tiles_of_one_large_file_are_made_by_many_compiled_tasks(spark, tmp_path):
    spark.createDataFrame([(3, 10**9)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got, whole = Q.QUERIES["chunk_tiles"](spark, str(tmp_path)), 7 * 10**9 // 12 * 12
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan and "Generate" in plan
    tasks = got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum("count").alias("bytes")).collect()
    assert sum(r["n"] for r in tasks) == -(-whole // 1200) and sum(r["bytes"] for r in tasks) == whole
    assert len(tasks) > 1 and max(r["n"] for r in tasks) < 0.6 * sum(r["n"] for r in tasks)


@pytest.mark.parametrize("later", [False, True])
def test_keys_are_restored_whatever_order_rows_arrive_in(spark, data, con, monkeypatch, later):
    whole, by = blocks.entry_deltas, [F.col(c).desc() if later else F.col(c) for c in ("quad_delta", "repos_delta")]
    monkeypatch.setattr(blocks, "entry_deltas", lambda rows: whole(rows).repartition(1).sortWithinPartitions(*by))
    agree(Q.QUERIES["prefix_sum_restore"](spark, data), con, Q.ORACLES["prefix_sum_restore"])


@pytest.mark.parametrize(("users", "most"), [("i * 300", 10000), ("nullif(i, 7)", 0)])
def test_points_over_the_bound_and_null_ones_are_counted(spark, tmp_path, users, most):
    at = "TIMESTAMP '2024-01-01' + to_minutes(CAST(i * 37 % 1440 AS BIGINT))"
    row = f"SELECT i AS event_id, {at} AS ts, {users} AS user_id, 'a' AS event_type, (i * 7919 % 49000) / 100.0 AS value, '' AS props FROM range(10000) r(i)"
    duckdb.execute(f"COPY ({row}) TO '{tmp_path}/events.parquet'")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    agree(Q.QUERIES["verified_run"](spark, str(tmp_path)), con, Q.ORACLES["verified_run"])
    points, over = con.execute(Q.ORACLES["verified_run"]).fetchone()
    assert points == 10000 and min(1, most) <= over <= most


def test_a_run_that_has_to_fail_does(spark):
    errors = spark.createDataFrame([(0.25,), (0.5,)], "err double")
    assert sorted(r["err"] for r in quality.assert_bound(errors, 0.5).collect()) == [0.25, 0.5]
    with pytest.raises(Exception, match="error over the bound: 0.5"):
        quality.assert_bound(errors, 0.4).collect()


def test_compression_ratios(spark, data):
    got = {(r["curve"], r["rle"]): r["ratio"] for r in Q.QUERIES["zstd_ratio"](spark, data).collect()}
    assert len(got) == 4 and all(v > 1 for v in got.values())


def test_other_queries_have_rows(spark, data):
    for name in sorted(set(Q.QUERIES) - set(Q.ORACLES) - {"codec_roundtrip", "zstd_ratio"}):
        assert Q.QUERIES[name](spark, data).count() > 0, name


def test_entry(spark):
    import __spark_entry__ as E

    assert set(Q.QUERIES) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())
    assert E.entry(spark).columns == ["qx", "qy", "qz", "cnt"]
