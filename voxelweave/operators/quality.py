"""Errors of recovered points, and sizes against sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def square_error(a=("x", "y", "z"), b=("rx", "ry", "rz")) -> Column:
    d = [F.col(p).cast("double") - F.col(q).cast("double") for p, q in zip(a, b)]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def with_error(df: DataFrame, a=("x", "y", "z"), b=("rx", "ry", "rz")) -> DataFrame:
    """df with err, the distance between original and recovered points of the same row."""
    return df.withColumn("_sq", square_error(a, b)).withColumn("err", F.sqrt("_sq"))


def error_stats(df: DataFrame, bound: float | Column, by: list[str] = ()) -> DataFrame:
    """n, max_err, mse, overflow (points over the bound), diagonal and psnr (null if the mse is 0) of a table with original x, y, z and err."""
    side = lambda c: (F.max(c).cast("double") - F.min(c).cast("double"))
    got = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.max("err").alias("max_err"), F.avg("_sq").alias("mse"), F.count_if(F.col("err") > (bound if isinstance(bound, Column) else F.lit(float(bound)))).alias("overflow"),
        F.sqrt(side("x") * side("x") + side("y") * side("y") + side("z") * side("z")).alias("diagonal"),
    )
    return got.withColumn("psnr", F.when((F.col("mse") > 0) & (F.col("diagonal") > 0), F.lit(10.0) * F.log10(F.col("diagonal") * F.col("diagonal") / F.col("mse"))))


def verify(df: DataFrame, original: str, recovered: str) -> DataFrame:
    """One row of a field's errors: range, psnr, nrmse, max_abs, max_rel, max_pointwise_rel, norm_err, norm_err_rel, correlation. Undefined ones are null."""
    a, b = F.col(original).cast("double"), F.col(recovered).cast("double")
    err = F.abs(b - a)
    got = df.agg((F.max(a) - F.min(a)).alias("range"), F.avg((b - a) * (b - a)).alias("_mse"), F.sum((b - a) * (b - a)).alias("_sse"), F.max(err).alias("max_abs"), F.max(F.when(a != 0, err / F.nullif(F.abs(a), F.lit(0.0)))).alias("max_pointwise_rel"), F.sum(b * b).alias("_l2"), F.corr(a, b).alias("correlation"))
    safe = lambda num, den: num / F.nullif(den, F.lit(0.0))
    return got.select(
        "range", F.when((F.col("range") > 0) & (F.col("_mse") > 0), F.lit(20.0) * F.log10("range") - F.lit(10.0) * F.log10("_mse")).alias("psnr"),
        safe(F.sqrt("_mse"), F.col("range")).alias("nrmse"), "max_abs", safe(F.col("max_abs"), F.col("range")).alias("max_rel"), "max_pointwise_rel",
        F.sqrt("_sse").alias("norm_err"), safe(F.sqrt("_sse"), F.sqrt("_l2")).alias("norm_err_rel"), "correlation",
    )


def assert_bound(df: DataFrame, bound: float) -> DataFrame:
    """df, which fails at run time with the first point whose err is over the bound."""
    return df.withColumn("err", F.when(F.col("err") <= F.lit(float(bound)), F.col("err")).otherwise(F.raise_error(F.concat(F.lit("error over the bound: "), F.col("err").cast("string"))).cast("double")))
