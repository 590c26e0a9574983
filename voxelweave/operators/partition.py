"""Owners of cells under four partitioners, and tables dealt by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import curves
from .ordered import owner, splitters

MODES = ("samplesort", "range", "hash", "prefix")


def check_mode(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"unknown partitioner {mode!r}; known: {', '.join(MODES)}")
    return mode


def range_owner(key: Column, least: Column, most: Column, n: int) -> Column:
    """Linear interpolation of the key between the least and the greatest one."""
    span = (most - least + 1).cast("double")
    return F.least(F.lit(n - 1), F.floor((key - least).cast("double") / span * F.lit(float(n)))).cast("int")


def prefix_owner(key: Column, bits: Column, n: int) -> Column:
    """The key as a fraction of 2**bits."""
    bits = F.least(F.greatest(bits, F.lit(1)), F.lit(63))
    return F.least(F.lit(n - 1), F.floor(key.cast("double") / F.pow(F.lit(2.0), bits.cast("double")) * F.lit(float(n)))).cast("int")


# The multipliers of the cell hash by axis, and of its finish.
AXIS = (73856093, 19349663, 83492791)
FINISH = 0xFF51AFD7ED558CCD


def _times(h: Column, by: int) -> Column:
    """Product modulo 2**64 of BIGINTs without overflow: by 16-bit parts of the multiplier, each partial product kept to its low bits.

    Low and high halves of h are 32 bits, parts of the multiplier 16, so products stay under 2**48.
    """
    low, high = h.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")), F.shiftrightunsigned(h, 32)
    out = None
    for i in range(4):
        part = F.lit(by >> (16 * i) & 0xFFFF).cast("bigint")
        for half, shift in ((low, 16 * i), (high, 16 * i + 32)):
            if shift < 64:
                term = F.shiftleft(half * part, shift)
                out = term if out is None else _add(out, term)
    return out


def _add(a: Column, b: Column) -> Column:
    """Sum modulo 2**64 by 32-bit halves."""
    mask = F.lit(0xFFFFFFFF).cast("bigint")
    low = a.bitwiseAND(mask) + b.bitwiseAND(mask)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(mask))


def with_hash_owner(df: DataFrame, n: int, name: str = "owner") -> DataFrame:
    """df with the owner of each cell under the mixed 64-bit hash, modulo n as unsigned. Steps are columns, so that none is written out twice."""
    unsigned = lambda q: F.col(q).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    h = None
    for q, m in zip(("qx", "qy", "qz"), AXIS):
        term = unsigned(q) * F.lit(m).cast("bigint")
        h = term if h is None else h.bitwiseXOR(term)
    out = df.withColumn("_h", h).withColumn("_h", F.col("_h").bitwiseXOR(F.shiftrightunsigned("_h", 33)))
    out = out.withColumn("_h", _times(F.col("_h"), FINISH)).withColumn("_h", F.col("_h").bitwiseXOR(F.shiftrightunsigned("_h", 33)))
    # unsigned remainder: the high half's and the low half's, put together
    high, low = F.shiftrightunsigned(F.col("_h"), 32), F.col("_h").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    rest = ((high % n) * F.lit((1 << 32) % n) + low % n) % n
    return out.withColumn(name, rest.cast("int")).drop("_h")


def with_owner(df: DataFrame, n: int, mode: str = "samplesort", bias: int = curves.Z_BIAS, name: str = "owner") -> DataFrame:
    """df with the part, 0 to n - 1, of each cell. samplesort and range read the keys once to find where to cut."""
    check_mode(mode)
    if mode == "hash":
        return with_hash_owner(df, n, name)
    keyed = curves.with_morton(df, F.col("qx"), F.col("qy"), F.col("qz") + bias, "_key")
    if mode == "samplesort":
        return keyed.withColumn(name, owner(F.col("_key"), splitters(keyed, "_key", n)).cast("int")).drop("_key")
    if mode == "range":
        ends = keyed.agg(F.min("_key").alias("_least"), F.max("_key").alias("_most"))
        return keyed.crossJoin(F.broadcast(ends)).withColumn(name, range_owner(F.col("_key"), F.col("_least"), F.col("_most"), n)).drop("_key", "_least", "_most")
    top = keyed.agg((curves.bit_length(F.coalesce(F.greatest(F.max("qx"), F.max("qy"), F.max("qz") + bias), F.lit(0))) * 3).alias("_bits"))
    return keyed.crossJoin(F.broadcast(top)).withColumn(name, prefix_owner(F.col("_key"), F.col("_bits"), n)).drop("_key", "_bits")


def deal(df: DataFrame, n: int, mode: str = "samplesort", bias: int = curves.Z_BIAS) -> DataFrame:
    """A cell table in n parts, sorted along the curve inside each; column part says which. Key ranges use Spark's own range partitioning."""
    keyed = curves.with_morton(df, F.col("qx"), F.col("qy"), F.col("qz") + bias)
    if check_mode(mode) == "samplesort":
        dealt = keyed.repartitionByRange(n, "sfc")
    else:
        dealt = with_owner(keyed, n, mode, bias, "_o").repartition(n, "_o").drop("_o")
    return dealt.sortWithinPartitions("sfc").withColumn("part", F.spark_partition_id())


def reservoir(df: DataFrame, by: list[str], key: str, size: int, seed: int = 0) -> DataFrame:
    """A sample of `size` rows at most of each group, alike for all rows: those whose md5 of the seed and the key is least (ties by key).

    The same rows come whatever the partitions are; Spark keeps the first `size` rows of each group in each task before it shuffles.
    """
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(draw, key))
    name = "_draw"
    while name in df.columns:
        name += "_"
    return df.withColumn(name, rank).filter(F.col(name) <= size).drop(name)


def round_robin(chunk: Column, n: int) -> Column:
    """The owner of a chunk number."""
    return F.pmod(chunk, F.lit(n)).cast("int")


def balance(df: DataFrame, part: str = "part") -> DataFrame:
    """One row: parts that have rows, the least and the most rows of a part, and least / most."""
    sizes = df.groupBy(part).agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("parts"), F.min("n").alias("least"), F.max("n").alias("most"), (F.min("n") / F.max("n")).alias("balance"))
