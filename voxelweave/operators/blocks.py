"""Hierarchical keys: superblock, octant and key inside the octant, their deltas and the way back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import curves
from ..functions.floats import free_prefix
from .cells import expand, ranges
from .ordered import deltas, running_sum


def entries(cells: DataFrame, hilbert: bool = False, bias: int = 0) -> DataFrame:
    """cells with id, quad and sfc, the local key; z is raised by `bias` first. The ranges are one row, which is broadcast."""
    p = free_prefix(cells, "_s")
    z, s = f"{p}z", f"{p}s"
    raised = cells.withColumn(z, F.col("qz") + bias)
    r = raised.agg(F.greatest(F.coalesce(F.max("qx"), F.lit(0)), F.lit(0)).alias("range_x"), F.greatest(F.coalesce(F.max("qy"), F.lit(0)), F.lit(0)).alias("range_y"))
    rows = raised.crossJoin(F.broadcast(r)).withColumn(s, curves.superblock(F.col("qx"), F.col("qy"), F.col(z), F.col("range_x"), F.col("range_y")))
    rows = rows.withColumns({c: F.col(s).getField(c) for c in ("id", "quad", "lx", "ly", "lz")}).drop(s, z)
    rows = curves.with_morton(rows, F.col("lx"), F.col("ly"), F.col("lz")).drop("lx", "ly", "lz")
    return rows.withColumn("sfc", curves.hilbert(F.col("sfc"), curves.BLOCK_ITERATION)) if hilbert else rows


def entry_deltas(rows: DataFrame) -> DataFrame:
    """id, quad, sfc, quad_delta (from 0 at a superblock's start) and repos_delta (from 0 at an octant's) of each row.

    Windows run over distinct cells; further rows of a cell have deltas of 0 and are dealt out where there are many.
    """
    cell = ("id", "quad", "sfc")
    block = Window.partitionBy("id").orderBy("quad", "sfc")
    octant = Window.partitionBy("id", "quad").orderBy("sfc")
    cells = rows.groupBy(*cell).agg(F.count("*").alias("cnt"))
    none = F.lit(0).cast("bigint")
    again = expand(cells.filter("cnt > 1").withColumn("cnt", F.col("cnt") - 1), cell=cell).select(*cell, none.cast("int").alias("quad_delta"), none.alias("repos_delta"))
    first = cells.withColumn("quad_delta", F.col("quad") - F.coalesce(F.lag("quad").over(block), F.lit(0))).withColumn("repos_delta", F.col("sfc") - F.coalesce(F.lag("sfc").over(octant), F.lit(0)))
    return first.drop("cnt").unionByName(again)


def positioned(rows: DataFrame, name: str = "position") -> DataFrame:
    """rows of entry_deltas with their place in their superblock's stream, from 1. A cell's first row, the one with its deltas, comes before the others, whose deltas are 0."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy("id").orderBy("quad", "sfc", F.desc("quad_delta"), F.desc("repos_delta"))))


def superblocks(rows: DataFrame) -> DataFrame:
    """id, cnt of each superblock."""
    return rows.groupBy("id").agg(F.count("*").alias("cnt"))


def superblock_deltas(blocks: DataFrame) -> DataFrame:
    """blocks with id_delta and the signed cnt_delta, in order of id."""
    from .ordered import vector_deltas

    got = vector_deltas(blocks.withColumn("_id", F.col("id")), "_id", ["id", "cnt"]).drop("_id")
    return got.withColumnsRenamed({"d_id": "id_delta", "d_cnt": "cnt_delta"})


def restore(rows: DataFrame, position: str) -> DataFrame:
    """quad and sfc back from the deltas: sums that start anew with each superblock, and with each octant."""
    block = Window.partitionBy("id").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    got = rows.withColumn("quad", F.sum("quad_delta").over(block))
    octant = Window.partitionBy("id", "quad").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return got.withColumn("sfc", F.sum("repos_delta").over(octant))


def cells_of(rows: DataFrame, hilbert: bool = False, bias: int = 0) -> DataFrame:
    """qx, qy, qz of rows with id, quad, sfc, range_x, range_y."""
    key = curves.hilbert_morton(F.col("sfc"), curves.BLOCK_ITERATION) if hilbert else F.col("sfc")
    p = free_prefix(rows, "_s")
    x, y, z, c = (f"{p}{n}" for n in "xyzc")
    local = curves.with_morton_cell(rows, key, (x, y, z))
    got = local.withColumn(c, curves.superblock_cell(F.col("id"), F.col("quad"), F.col(x), F.col(y), F.col(z), F.col("range_x"), F.col("range_y")))
    cell = F.col(c)
    return got.select("*", cell.getField("qx").alias("qx"), cell.getField("qy").alias("qy"), (cell.getField("qz") - bias).alias("qz")).drop(c, x, y, z)


def direct_keys(cells: DataFrame, hilbert: bool = False, bias: int = 0) -> DataFrame:
    """cells with sfc over the whole range; cells that 21 bits an axis can't hold raise an error."""
    z = f"{free_prefix(cells, '_s')}z"
    raised = cells.withColumn(z, F.col("qz") + bias)
    cell = [F.col(c) for c in ("qx", "qy", z)]
    keyed = curves.with_morton(raised, *cell).withColumn("sfc", curves.checked(F.col("sfc"), *cell))
    if not hilbert:
        return keyed.drop(z)
    top = raised.agg(curves.bit_length(F.coalesce(F.max(F.greatest(*cell)), F.lit(0))).alias("iteration"))
    return keyed.crossJoin(F.broadcast(top)).withColumn("sfc", curves.hilbert(F.col("sfc"), F.col("iteration"))).drop(z)


def direct_deltas(keys: DataFrame) -> DataFrame:
    """keys with delta along the whole curve."""
    return deltas(keys, "sfc")


def is_direct(cells: DataFrame, threshold: int = 1024) -> bool:
    """Whether the whole range is under the threshold, so that one curve covers it."""
    r = ranges(cells).first()
    return max(r) < threshold


__all__ = ["cells_of", "direct_deltas", "direct_keys", "entries", "entry_deltas", "is_direct", "positioned", "restore", "running_sum", "superblock_deltas", "superblocks"]
