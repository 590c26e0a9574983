"""Cell tables: distinct cells with the count of their points."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.floats import free_prefix

CELL = ("qx", "qy", "qz")
#: Rows that one expanded row may make before cells are dealt anew.
WIDE = 10_000


def cell_counts(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Points by cell (and chunk): cnt. Map tasks add up first, so a cell that many points share shuffles as a few rows."""
    return df.groupBy(*by, *CELL).agg(F.count("*").alias("cnt"))


def merge_counts(*tables: DataFrame) -> DataFrame:
    """The cell table of all tables' points together."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy(*CELL).agg(F.sum("cnt").alias("cnt"))


def duplicate_ratio(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    """One row (or one a group): points, cells, ratio = 1 - cells / points (0 for none)."""
    got = counts.groupBy(*by).agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("points"), F.count("*").alias("cells"))
    return got.withColumn("ratio", F.when(F.col("points") > 0, 1 - F.col("cells") / F.col("points")).otherwise(F.lit(0.0)))


def expand(counts: DataFrame, parts: int = 1000, cell: tuple[str, ...] = CELL) -> DataFrame:
    """A row for each point (cell: what tells cells apart). Cells of many points are first split into parts, dealt over the tasks, so none makes them alone."""
    n, p = F.col("cnt").cast("bigint"), free_prefix(counts, "_e")
    many, i, k, one = (f"{p}{c}" for c in "nik1")
    split = F.when(n > WIDE, F.least(F.lit(parts).cast("bigint"), F.ceil(n / WIDE).cast("bigint"))).otherwise(F.lit(1).cast("bigint"))
    pieces = counts.withColumn(many, split).withColumn(i, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(many) - 1)))
    pieces = pieces.withColumn(k, F.floor((F.col(i) + 1) * n / F.col(many)).cast("bigint") - F.floor(F.col(i) * n / F.col(many)).cast("bigint"))
    hot = pieces.filter(F.col(many) > 1).repartition(*cell, i)
    rows = pieces.filter(F.col(many) == 1).unionByName(hot)
    return rows.withColumn(one, F.explode(F.array_repeat(F.lit(1), F.col(k).cast("int")))).drop(one, k, i, many, "cnt")


def ranges(df: DataFrame) -> DataFrame:
    """One row: the greatest cell of each axis, 0 at least."""
    return df.agg(*[F.greatest(F.coalesce(F.max(q), F.lit(0)), F.lit(0)).alias(f"range_{q[1]}") for q in CELL])
