"""Float32 arithmetic and roundings that Spark and other engines compute alike."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def f32(value: float) -> float:
    """The double with the value of the nearest float32."""
    return float(np.float32(value))


def named(column: str) -> Column:
    """A column by its name as it stands, dots and quotes included."""
    return F.col("`" + column.replace("`", "``") + "`")


def free_prefix(df: DataFrame, prefix: str) -> str:
    """What names of intermediate columns may begin with, as no column's name does."""
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    return prefix


def divide(x: Column, by: float | Column) -> Column:
    """float32 quotient: the double quotient rounded once more equals it."""
    by = by.cast("float").cast("double") if isinstance(by, Column) else F.lit(f32(by))
    return (x.cast("double") / by).cast("float")


def times(x: Column, by: float | Column) -> Column:
    by = by.cast("float").cast("double") if isinstance(by, Column) else F.lit(f32(by))
    return (x.cast("double") * by).cast("float")


def nearest(x: Column) -> Column:
    """Nearest integer of a double, halves away from zero."""
    return F.when(x >= 0, F.floor(x + 0.5)).otherwise(-F.floor(F.lit(0.5) - x))


def fixed(x: Column, places: int = 6) -> Column:
    """Rounded to places by plain double arithmetic, so that engines agree."""
    scale = float(10**places)
    return F.floor(x.cast("double") * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)
