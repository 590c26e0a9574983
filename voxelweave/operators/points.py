"""Point tables: columns x, y, z (FLOAT) and any others, which pass through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.floats import free_prefix

#: Tiles that a row makes at a time, tiles that a task aims at, and the most tasks.
RUN, TASK_TILES, MOST_TASKS = 4096, 1 << 22, 4096


def points(df: DataFrame, x, y, z, **others) -> DataFrame:
    """A point table from expressions; coordinates are cast to float32."""
    axes = [F.expr(c) if isinstance(c, str) else c for c in (x, y, z)]
    more = [(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in others.items()]
    return df.select(*more, *[c.cast("float").alias(n) for c, n in zip(axes, "xyz")])


def finite(df: DataFrame) -> DataFrame:
    """The points whose coordinates are numbers: rows with null, NaN or infinity in one are left out."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return df.filter(ok("x") & ok("y") & ok("z"))


def offset(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """ox, oy, oz: the least coordinate of each axis, of the table or of each group."""
    return df.groupBy(*by).agg(*[F.min(c).alias(f"o{c}") for c in "xyz"])


def with_offset(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """df with ox, oy, oz. The table's offset is one row, which is broadcast; a group's comes by a join on its keys."""
    least = offset(df, by)
    return df.join(least, list(by)) if by else df.crossJoin(F.broadcast(least))


def shift(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Points relative to their offset, which stays in ox, oy, oz; an empty table stays empty."""
    moved = with_offset(df, by)
    return moved.withColumns({c: (F.col(c) - F.col(f"o{c}")).cast("float") for c in "xyz"})


def unshift(df: DataFrame) -> DataFrame:
    """Adds ox, oy, oz and drops them."""
    return df.withColumns({c: (F.col(c) + F.col(f"o{c}")).cast("float") for c in "xyz"}).drop("ox", "oy", "oz")


def box(df: DataFrame) -> DataFrame:
    """One row: least and greatest coordinate of each axis and the diagonal's length."""
    sides = df.agg(*[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"])
    side = lambda c: F.col(f"max_{c}").cast("double") - F.col(f"min_{c}").cast("double")
    return sides.withColumn("diagonal", F.sqrt(side("x") * side("x") + side("y") * side("y") + side("z") * side("z")))


def quantize(df: DataFrame, lattice) -> DataFrame:
    """df with int columns qx, qy, qz of the (shifted) points' cells."""
    return lattice.quantize(df)


def recover(df: DataFrame, lattice, names=("rx", "ry", "rz")) -> DataFrame:
    """df with the float coordinates of its cells' points."""
    point = df.withColumn("_point", lattice.point(F.col("qx"), F.col("qy"), F.col("qz")))
    return point.withColumns({n: F.col(f"_point.{c}") for n, c in zip(names, "xyz")}).drop("_point")


def _whole_records(size: int, record: int) -> int:
    size -= size % record
    if size <= 0:
        raise ValueError("a chunk must hold one record at least")
    return size


def tiles(total: Column, size: int, record: int = 12) -> Column:
    """Array of (offset, count) byte ranges that tile `total` bytes; both are multiples of the record's size."""
    size = _whole_records(size, record)
    whole = total - total % record
    n = F.ceil(whole / size).cast("bigint")
    at = F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(n - 1, F.lit(0))), lambda i: F.struct((i * size).alias("offset"), F.least(F.lit(size).cast("bigint"), whole - i * size).alias("count")))
    return F.filter(at, lambda t: t["count"] > 0)


def tile_rows(df: DataFrame, total: str, size: int, by: list[str], record: int = 12) -> DataFrame:
    """df with offset and count, a row for each of the `tiles` of column `total`; none where that is null or under a record.

    Tiles may be thousands of times as many as rows: they are made by compiled steps (lambdas over arrays are interpreted), a run at a
    time, and runs are dealt by (by, start) over as many tasks as one pass over the totals asks for, so neither a large file nor a
    small table of files is one task's. by: columns that tell rows apart.
    """
    size, p = _whole_records(size, record), free_prefix(df, "_t")
    whole, first = f"{p}whole", f"{p}first"
    long = lambda v: F.lit(v).cast("bigint")
    files = df.withColumn(whole, (F.col(total) - F.col(total) % record).cast("bigint")).filter(F.col(whole) > 0)
    n = files.agg(F.sum(F.floor((F.col(whole) - 1) / size) + 1)).first()[0] or 0
    tasks = min(MOST_TASKS, max(-(-n // TASK_TILES), min(df.sparkSession.sparkContext.defaultParallelism, n >> 16)))
    runs = files.withColumn(first, F.explode(F.sequence(long(0), F.col(whole) - 1, long(size * RUN))))
    runs = runs.repartition(tasks, *by, first) if tasks > 1 else runs
    end = F.least(F.col(first) + long(size * RUN), F.col(whole))
    made = runs.withColumn("offset", F.explode(F.sequence(F.col(first), end - 1, long(size))))
    return made.withColumn("count", F.least(long(size), F.col(whole) - F.col("offset"))).drop(whole, first)


def in_range(df: DataFrame, index: str, first: int, count: int = 0) -> DataFrame:
    """Rows whose index lies in a range; count 0 reads to the end."""
    kept = df.filter(F.col(index) >= first)
    return kept.filter(F.col(index) < first + count) if count else kept
