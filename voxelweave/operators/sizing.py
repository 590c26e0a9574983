"""Sizes in bits of integer columns under each code, as aggregates and expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.curves import bit_length

PATCH = 254
MOST_RICE, MOST_ORDER = 62, 16


def zigzag(v: Column) -> Column:
    return F.shiftleft(v.cast("bigint"), 1).bitwiseXOR(F.shiftright(v.cast("bigint"), 63))


def unzigzag(v: Column) -> Column:
    return F.shiftright(v, 1).bitwiseXOR(-v.bitwiseAND(F.lit(1).cast("bigint")))


def patched(v: Column) -> Column:
    """Struct of symbol (0 for a patch, else v + 1) and patch (null, or the value over 254)."""
    over = v > PATCH
    return F.struct(F.when(over, F.lit(0).cast("bigint")).otherwise(v + 1).alias("symbol"), F.when(over, v).alias("patch"))


def unpatched(symbol: Column, patch: Column) -> Column:
    return F.when(symbol == 0, patch).otherwise(symbol - 1)


def split_patches(df: DataFrame, value: str, position: str) -> tuple[DataFrame, DataFrame]:
    """(position, symbol) of all rows, and (patch_no, patch) of the outliers, numbered from 1 in order of position."""
    from .ordered import ranked

    split = df.select(position, patched(F.col(value)).alias("p")).select(position, "p.symbol", "p.patch")
    patches = ranked(split.filter("symbol = 0").select(position, "patch"), position, name="patch_no").select("patch_no", "patch")
    return split.select(position, "symbol"), patches


def merge_patches(symbols: DataFrame, patches: DataFrame, position: str) -> DataFrame:
    """(position, value): the i-th zero symbol takes the i-th patch."""
    from .ordered import ranked

    zeros = ranked(symbols.filter("symbol = 0"), position, name="patch_no").join(patches, "patch_no").select(position, F.col("patch").alias("value"))
    return symbols.filter("symbol <> 0").select(position, (F.col("symbol") - 1).alias("value")).unionByName(zeros)


def bitpack_size(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """n, width and bytes of a column packed at the width of its maximum."""
    got = df.groupBy(*by).agg(F.count(value).alias("n"), bit_length(F.coalesce(F.max(value), F.lit(0))).alias("width"))
    return got.withColumn("bytes", F.ceil(F.col("n") * F.col("width") / 8))


def rice_k(mean: Column) -> Column:
    return F.when(mean >= 1, F.least(F.floor(F.log2(F.when(mean >= 1, mean))), F.lit(MOST_RICE))).otherwise(F.lit(0)).cast("int")


def rice_size(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """n, k and bits under Golomb-Rice with the k that the mean gives.

    The sum over rows of v >> k for every k is taken in the same pass as the mean, so the table is read once.
    """
    shifts = [F.sum(F.shiftright(F.col(value), k)).alias(f"_s{k}") for k in range(MOST_RICE + 1)]
    got = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("_mean"), *shifts).withColumn("k", rice_k(F.coalesce("_mean", F.lit(0.0))))
    total = F.element_at(F.array(*[F.col(f"_s{k}") for k in range(MOST_RICE + 1)]), F.col("k") + 1)
    return got.select(*by, "n", "k", (F.coalesce(total, F.lit(0)) + F.col("n") * (F.col("k") + 1)).alias("bits"))


def exp_golomb_bits(v: Column, k: int) -> Column:
    return 2 * bit_length(F.shiftright(v, k) + 1) - 1 + k


def exp_golomb_size(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """n, the order k of least bits (the smallest of equals) and its bits; orders 0 to 16 are summed in one pass."""
    got = df.groupBy(*by).agg(F.count(value).alias("n"), *[F.sum(exp_golomb_bits(F.col(value), k)).alias(f"_b{k}") for k in range(MOST_ORDER + 1)])
    best = F.array_min(F.array(*[F.struct(F.coalesce(F.col(f"_b{k}"), F.lit(0)).alias("bits"), F.lit(k).alias("k")) for k in range(MOST_ORDER + 1)]))
    return got.withColumn("_best", best).select(*by, "n", F.col("_best.k").alias("k"), F.col("_best.bits").alias("bits"))


def frequencies(df: DataFrame, symbol: str, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(symbol).alias("symbol")).agg(F.count("*").alias("freq"))


def complete(freq: DataFrame, most: int = 255) -> DataFrame:
    """Frequencies of all symbols 0 .. most; missing ones count once, so that a shared codebook covers every chunk."""
    every = freq.sparkSession.range(most + 1).select(F.col("id").alias("symbol"))
    return every.join(F.broadcast(freq.filter(F.col("symbol").between(0, most))), "symbol", "left").select("symbol", F.coalesce("freq", F.lit(1)).alias("freq"))


def entropy(freq: DataFrame, by: list[str] = ()) -> DataFrame:
    """n, distinct and Shannon entropy in bits: log2 n - sum(f log2 f) / n."""
    f = F.col("freq").cast("double")
    got = freq.groupBy(*by).agg(F.sum("freq").alias("n"), F.count("*").alias("distinct"), F.sum(f * F.log2(f)).alias("_s"))
    return got.select(*by, "n", "distinct", (F.log2(F.col("n").cast("double")) - F.col("_s") / F.col("n")).alias("entropy"))
