"""Roll-ups of runs: chunk-size sweeps, scaling over nodes, run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.curves import Z_BIAS, bit_length, with_morton
from ..functions.lattice import lattice
from ..operators import ordered, points as P, quality

RECORD = 12


def sweep(df: DataFrame, index: str, sizes: list[int], variants: list[tuple[str, float]]) -> DataFrame:
    """A row for each chunk size (in points; 0: all in one) and variant (lattice, bound): num_chunks, input and modelled compressed bytes, ratio, mean psnr.

    The model: keys of a chunk's distinct cells as bit-packed deltas, counts bit-packed. All sizes and variants
    are rows of one table, so one pass of shuffles serves them all, but for size 0: there the offset is one broadcast row and
    deltas go along a global order, so that no task holds the whole cloud.
    """
    whole_too = 0 in sizes
    some = [s for s in sizes if s > 0]
    parts = []
    if some:
        each = df.withColumn("chunk_points", F.explode(F.array(*[F.lit(s) for s in some])))
        each = each.withColumn("chunk", F.floor(F.col(index) / F.col("chunk_points")).cast("bigint"))
        parts.append(P.shift(each, ["chunk_points", "chunk"]))
    if whole_too:
        parts.append(P.shift(df).withColumns({"chunk_points": F.lit(0), "chunk": F.lit(0).cast("bigint")}))
    by, rows = ["chunk_points", "variant", "chunk"], None
    for shifted in parts:
        for name, bound in variants:
            cells = P.recover(P.quantize(shifted, lattice(name, bound)), lattice(name, bound))
            got = quality.with_error(cells).withColumn("variant", F.lit(f"{name}-{bound:g}"))
            rows = got if rows is None else rows.unionByName(got)
    stats = quality.error_stats(rows, float("inf"), by).select(*by, "n", "psnr")
    keys = with_morton(rows.groupBy(*by, "qx", "qy", "qz").agg(F.count("*").alias("cnt")), F.col("qx"), F.col("qy"), F.col("qz") + Z_BIAS)
    delta = F.col("sfc") - F.coalesce(F.lag("sfc").over(Window.partitionBy(*by).orderBy("sfc")), F.lit(0))
    moved = keys.filter("chunk_points > 0").withColumn("delta", delta)
    for name, bound in variants if whole_too else ():
        moved = moved.unionByName(ordered.deltas(keys.filter((F.col("chunk_points") == 0) & (F.col("variant") == f"{name}-{bound:g}")), "sfc"))
    packed = moved.groupBy(*by).agg(F.count("*").alias("cells"), F.max("delta").alias("most"), F.max("cnt").alias("most_cnt"))
    packed = packed.withColumn("bytes", F.ceil(F.col("cells") * (bit_length(F.col("most")) + bit_length(F.col("most_cnt"))) / 8))
    whole = stats.join(packed, by).groupBy("chunk_points", "variant").agg(F.count("*").alias("num_chunks"), (F.sum("n") * RECORD).alias("input_bytes"), F.sum("bytes").alias("compressed_bytes"), F.avg("psnr").alias("mean_psnr"))
    return whole.withColumn("ratio", F.col("input_bytes") / F.nullif(F.col("compressed_bytes"), F.lit(0)))


def pivot(df: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """One row for each `row`, one column for each of `columns`; a value that is there several times counts once (the least)."""
    return df.groupBy(row).pivot(column, columns).agg(F.min(value))


def scaling(df: DataFrame, nodes: str = "nodes", block: str = "block_mib", throughput: str = "throughput") -> DataFrame:
    """df with speedup and parallel_efficiency against the fewest nodes of the same block size; null where that has no throughput."""
    order = Window.partitionBy(block).orderBy(nodes)
    base, least = F.first(throughput).over(order), F.first(nodes).over(order)
    speedup = F.when(base > 0, F.col(throughput) / F.nullif(base, F.lit(0.0)))
    return df.withColumn("speedup", speedup).withColumn("parallel_efficiency", F.col("speedup") / (F.col(nodes) / least))


def run_summary(ranks: DataFrame) -> DataFrame:
    """One row for a run from a row a rank (rank, input_bytes, compressed_bytes, blocks, wall_s): totals, extremes, balance, throughput and the rows themselves."""
    got = ranks.agg(
        F.count("*").alias("nranks"), F.sum("blocks").alias("num_blocks"), F.sum("input_bytes").alias("input_bytes"), F.sum("compressed_bytes").alias("compressed_bytes"),
        F.max("wall_s").alias("wall_max_s"), F.min("wall_s").alias("wall_min_s"), F.sort_array(F.collect_list(F.struct("rank", "input_bytes", "compressed_bytes", "blocks", "wall_s"))).alias("per_rank"),
    )
    safe = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    return got.withColumn("ratio", safe("input_bytes", "compressed_bytes")).withColumn("load_balance", safe("wall_min_s", "wall_max_s")).withColumn("throughput_GBps", safe("input_bytes", "wall_max_s") / 1e9)


def scrape(lines: DataFrame, run: str, line: str, patterns: dict[str, str]) -> DataFrame:
    """One row a run with a double for each pattern: the first group of the last line, by `position`, that it matches; null if none does."""
    found = [F.nullif(F.regexp_extract(F.col(line), p, 1), F.lit("")).cast("double").alias(n) for n, p in patterns.items()]
    rows = lines.select(run, "position", *found)
    return rows.groupBy(run).agg(*[F.max_by(F.col(n), F.when(F.col(n).isNotNull(), F.col("position"))).alias(n) for n in patterns])


def manifest_index(manifest: DataFrame) -> DataFrame:
    """Blocks, bytes and the span of each rank's part file."""
    return manifest.groupBy("rank").agg(F.count("*").alias("blocks"), F.sum("input_size").alias("input_bytes"), F.sum("compressed_size").alias("compressed_bytes"), F.max(F.col("part_offset") + F.col("compressed_size")).alias("part_bytes"))


def write_sheets(path: str, **sheets: DataFrame) -> None:
    """Each report as a CSV folder of its name."""
    for name, df in sheets.items():
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
